"""The parsers on a small tree of invented files, with the rows they must give written out as SQL values.

Tables of source texts need not hold every framework that the parsers know; this
tree holds one file of each kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import resolve
from symloom.sources import code
from symloom.sources import frameworks as W

TREE: tuple[tuple[int, str, str, str], ...] = (
    (1, "web/Cart.jsx", "javascript", """import { useState } from 'react';
export function CartRow({ item, onDrop }) {
  return <li onClick={onDrop}>{item.title}</li>;
}
const CartList = ({ rows }) => {
  const [open, setOpen] = useState(true);
  useLedger();
  // <Ghost/> is no part
  return <Panel title="cart">{rows.map(r => <CartRow key={r.id} item={r} />)}</Panel>;
};
export default CartList;
"""),
    (2, "src/pages/orders/[id].tsx", "typescript", "export default function Order() { return <main/>; }\n"),
    (3, "app/api/orders/[id]/route.ts", "typescript", "export async function GET(r) { return r; }\nexport async function DELETE(r) { return r; }\n"),
    (4, "server/main.js", "javascript", """const express = require('express');
const app = express();
app.use(express.json);
app.use('/admin', guard);
app.get('/orders/:id', orders.show);
router.post('/orders', orders.store);
"""),
    (5, "routes/api.php", "php", """<?php
Route::prefix('shop')->middleware(['auth'])->group(function () {
    Route::get('/orders/{id}', [OrderController::class, 'show']);
    Route::apiResource('carts', CartController::class);
});
Route::post('/ping', [PingController::class, 'store'])->middleware('throttle');
"""),
    (6, "app/Models/Order.php", "php", """<?php
namespace App\\Models;
class Order extends Model {
    public function lines() { return $this->hasMany(OrderLine::class); }
    public function owner() { return $this->belongsTo(\\App\\Models\\User::class); }
}
class ShipOrder implements ShouldQueue { }
class OrderController extends Controller { public function show($id) { return $id; } }
"""),
    (7, "db/entities.ts", "typescript", """import { Entity, OneToMany } from 'typeorm';
@Entity('orders')
export class OrderEntity {
  @OneToMany(() => LineEntity, (l) => l.order) lines: LineEntity[];
}
@Entity()
class LineEntity { id: number; }
"""),
    (8, "db/user.js", "javascript", """const mongoose = require('mongoose');
const s = new mongoose.Schema({ team: { type: Id, ref: 'Team' } });
module.exports = mongoose.model('User', s);
"""),
    (9, "db/schema.prisma", "prisma", "model Post {\n  id Int @id\n  author User\n  tags Tag[]\n}\n"),
    (10, "jobs/mail.js", "javascript", """const { Queue, Worker } = require('bullmq');
const mails = new Queue('mails');
mails.add('welcome', { to: 1 });
new Worker('mails', run);
"""),
    (11, "tests/cart.test.js", "javascript", """describe('cart', () => {
  it('adds', () => { const f = jest.fn(); expect(add(f)).toBe(1); expect(2).toBe(2); });
  test('drops', () => { assert.ok(drop()); });
});
"""),
    (12, "package.json", "json", '{"dependencies": {"vue": "^3.4.0", "express": "4"}, "devDependencies": {"jest": "29"}}'),
    (13, "src/api.ts", "typescript", """const BASE = '/api';
const ORDERS = `${BASE}/orders`;
axios.get(ORDERS);
axios.post(BASE + '/orders/' + id, body);
fetch(`${BASE}/orders/${order.id}`, { method: 'PUT' });
axios.get('/api/plain');
"""),
    (14, "stores/cart.ts", "typescript", """export const useCart = defineStore('cart', {});
export function useTotals() { provide('totals', 1); }
"""),
    (15, "game/main.tscn", "godot", '[ext_resource path="res://p.cs" type="Script" id="1"]\n[node name="Root" type="Node2D"]\n[node name="Hero" type="Sprite2D" parent="."]\n'),
    (16, "game/Hero.cs", "csharp", """using Godot;
public class Hero : Node2D {
    [Signal] public delegate void Fell(int depth);
    public void Go(int n) { EmitSignal("Fell"); Timer.Connect("timeout", this); Log("x", 3, null); }
}
"""),
    (17, "game/project.godot", "godot", '[autoload]\nState="*res://State.cs"\n\n[display]\nwidth=3\n'),
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TREE), "file_id long, path string, language string, content string")


def _values(columns: str, *rows: tuple) -> str:
    def literal(v: object) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def sample(columns: str, *rows: tuple):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(tree(spark))
        ORACLES[f.__name__] = _values(columns, *rows)
        return f

    return add


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(a, " ") for a in arrays})


@sample("file_id, name, kind, props, hooks, parts, line", (1, "CartRow", "function", "item onDrop", "", "", 2), (1, "CartList", "function", "rows", "useState useLedger", "Panel CartRow", 5), (2, "Order", "function", "", "", "", 1))
def pa06_react_sample(t: DataFrame) -> DataFrame:
    schema = "name string, kind string, props array<string>, hooks array<string>, parts array<string>, line int"
    return _joined(W.rows_of(t, lambda p, x, lang: W.react_components(x), schema, "language in ('javascript', 'typescript')"), "props", "hooks", "parts")


@sample("file_id, kind, route, method", (2, "page", "/orders/{id}", ""), (3, "api", "/api/orders/{id}", "GET"), (3, "api", "/api/orders/{id}", "DELETE"))
def pa07_next_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.next_page(p, x), "kind string, route string, method string")


@sample("file_id, method, path, handler, line", (4, "GET", "/orders/:id", "orders.show", 5), (4, "POST", "/orders", "orders.store", 6))
def pa08_node_routes_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t.where("file_id = 4"), lambda p, x, lang: code.routes(x), "method string, path string, handler string, line int")


@sample("file_id, owner, verb, path, what, line", (4, "app", "use", None, "express.json", 3), (4, "app", "use", "/admin", "guard", 4))
def pa08_node_middleware_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.middlewares(x), "owner string, verb string, path string, what string, line int")


@sample(
    "file_id, method, path, handler, middleware, line", (5, "GET", "/shop/orders/{id}", "[OrderController::class, 'show']", "auth", 3), (5, "GET", "/shop/carts", "[CartController::class, 'index']", "auth", 4), (5, "POST", "/shop/carts", "[CartController::class, 'store']", "auth", 4),
    (5, "GET", "/shop/carts/{id}", "[CartController::class, 'show']", "auth", 4), (5, "PUT", "/shop/carts/{id}", "[CartController::class, 'update']", "auth", 4), (5, "DELETE", "/shop/carts/{id}", "[CartController::class, 'destroy']", "auth", 4),
    (5, "POST", "/ping", "[PingController::class, 'store']", "throttle", 6),
)
def pa09_laravel_routes_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.laravel_routes(x), "method string, path string, handler string, middleware string, line int", "language = 'php'")


@sample("file_id, class, kind, member, relation, target", (6, "Order", "model", "lines", "hasMany", "OrderLine"), (6, "Order", "model", "owner", "belongsTo", "User"), (6, "ShipOrder", "job", "", None, None), (6, "OrderController", "controller", "", None, None))
def pa09_laravel_classes_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.laravel_classes(x), "class string, kind string, member string, relation string, target string", "language = 'php'")


@sample(
    "file_id, kind, name, type, parent", (15, "resource", "1", "Script", "res://p.cs"), (15, "node", "Root", "Node2D", None), (15, "node", "Hero", "Sprite2D", "."), (16, "signal", "Fell", None, None), (16, "emit", "Fell", None, None),
    (16, "connect", "Timer", "timeout", None), (17, "autoload", "State", None, "res://State.cs"),
)
def pa10_godot_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.godot(p, x), "kind string, name string, type string, parent string", "path like 'game/%'")


@sample(
    "file_id, library, entity, field, relation, target", (7, "typeorm", "OrderEntity", "lines", "OneToMany", "LineEntity"), (7, "typeorm", "LineEntity", "", None, None), (8, "mongoose", "User", "team", "ref", "Team"),
    (9, "prisma", "Post", "author", "one", "User"), (9, "prisma", "Post", "tags", "many", "Tag"),
)
def pa11_orm_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.orm_entities(x), "library string, entity string, field string, relation string, target string")


@sample("file_id, kind, library, name, line", (10, "queue", "bullmq", "mails", 2), (10, "job", "bullmq", "welcome", 3), (10, "worker", "bullmq", "mails", 4))
def pa12_jobs_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.jobs(x), "kind string, library string, name string, line int")


@sample("file_id, kind, title, line, assertions, mocks", (11, "suite", "cart", 1, 0, 0), (11, "case", "adds", 2, 2, 1), (11, "case", "drops", 3, 1, 0))
def pa13_tests_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.test_suites(x), "kind string, title string, line int, assertions int, mocks int", "path like 'tests/%'")


@sample("file_id, section, name, version", (12, "dependencies", "vue", "^3.4.0"), (12, "dependencies", "express", "4"), (12, "devDependencies", "jest", "29"))
def pa14_packages_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: code.manifest(x), "section string, name string, version string", "language = 'json'")


@sample("file_id, client, method, url, line", (13, "axios", "GET", "/api/orders", 3), (13, "axios", "POST", "/api/orders/{id}", 4), (13, "fetch", "PUT", "/api/orders/{id}", 5), (13, "axios", "GET", "/api/plain", 6))
def pa15_api_calls_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.api_calls(x), "client string, method string, url string, line int", "language = 'typescript'")


@sample("file_id, kind, name, line", (14, "store", "cart", 1), (14, "composable", "useCart", 1), (14, "composable", "useTotals", 2), (14, "provide", "totals", 2))
def pa05_stores_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.composables(x), "kind string, name string, line int")


@sample("file_id, caller, callee, parameter_context, kinds, line", (16, "Go", "EmitSignal", '("Fell")', "string", 4), (16, "Go", "Connect", '("timeout", this)', "string expression", 4), (16, "Go", "Log", '("x", 3, null)', "string int null", 4))
def pa04_contexts_sample(t: DataFrame) -> DataFrame:
    schema = "caller string, callee string, parameter_context string, kinds array<string>, line int"
    return _joined(W.rows_of(t, lambda p, x, lang: W.call_contexts(x, lang), schema, "language = 'csharp'"), "kinds")


@sample("file_id, framework, evidence", (1, "react", "code"), (4, "node", "code"), (5, "laravel", "folder"), (6, "laravel", "folder"), (12, "jest", "manifest"), (12, "node", "manifest"), (12, "vue", "manifest"), (15, "godot", "file"), (16, "godot", "code"), (17, "godot", "file"))
def ig08_frameworks_sample(t: DataFrame) -> DataFrame:
    return W.rows_of(t, lambda p, x, lang: W.framework_evidence(p, x), "framework string, evidence string")


@sample("method, path, class_id, handler_id", ("GET", "/orders/{id}", 2, 3), ("POST", "/ping", None, None))
def rs11_handlers_sample(t: DataFrame) -> DataFrame:
    spark = t.sparkSession
    symbols = spark.createDataFrame([(2, "OrderController", "class", None), (3, "show", "method", 2), (4, "show", "method", 9)], "id long, name string, symbol_type string, parent_symbol_id long")
    routes = W.rows_of(t.where("file_id = 5"), lambda p, x, lang: code.routes(x), "method string, path string, handler string, line int")
    return resolve.route_handlers(routes, symbols).select("method", "path", "class_id", "handler_id")


@sample("name, path", ("App\\Http\\A", "http/A"), ("App\\Models\\B", "app/Models/B"), ("@/x/y", "src/x/y"))
def rs08_autoload_sample(t: DataFrame) -> DataFrame:
    spark = t.sparkSession
    names = spark.createDataFrame([("App\\Http\\A",), ("App\\Models\\B",), ("@/x/y",), ("Other\\C",), (None,)], "name string")
    rules = spark.createDataFrame([("App\\", "app/"), ("App\\Http\\", "http"), ("@/*", "src/*")], "prefix string, folder string")
    return resolve.autoloaded(names, rules)
