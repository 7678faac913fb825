from symloom.sources import code


def test_script_symbols_and_calls():
    text = """import { a as b, c } from './x';
const y = require('y');
// function notMe() {}
export class Foo extends Bar {
  async run(p) { return this.go(p, "function no() {}"); }
}
export function top(a) { return helper(a); }
const arrow = async (x) => { return x; };
export { arrow as z };
"""
    found = {s["name"]: s for s in code.symbols(text, "javascript")}
    assert set(found) == {"Foo", "run", "top", "arrow"}
    assert found["run"]["parent"] == "Foo" and found["Foo"]["base_class"] == "Bar"
    assert (found["Foo"]["start_line"], found["Foo"]["end_line"]) == (4, 6)
    assert [(i[0], i[2]) for i in code.imports(text, "javascript")] == [("./x", "import"), ("y", "require")]
    assert ("top", "", "helper", 7) in code.calls(text, "javascript")
    assert [e[0] for e in code.exports(text, "javascript")] == ["Foo", "top", "z"]


def test_php_csharp_and_vue():
    php = "<?php\nnamespace App;\nuse App\\Models\\User;\nclass A extends B\n{\n  public function f(int $x): int { return $x; }\n}\n"
    found = {s["name"]: s["symbol_type"] for s in code.symbols(php, "php")}
    assert found == {"App": "namespace", "A": "class", "f": "method"}
    cs = "using System;\nnamespace N;\npublic class A : B\n{\n    public int F(int x) => x;\n    private void G()\n    {\n    }\n}\n"
    assert {s["name"] for s in code.symbols(cs, "csharp")} == {"N", "A", "F", "G"}
    vue = '<template><Card><slot name="x"/></Card></template>\n<script setup>\nconst p = defineProps({ title: String, size: Number });\nemit("save");\nfunction go() {}\n</script>\n'
    c = code.vue_component(vue)
    assert c["components"] == ["Card"] and c["slots"] == ["x"] and c["emits"] == ["save"] and c["props"][:1] == ["title"]
    assert [(s["name"], s["start_line"]) for s in code.symbols(vue, "vue")] == [("go", 5)]


def test_http_routes_suites_scenes_manifests():
    assert code.http_calls("axios.post('/api/users', d)\nfetch(`/api/x/${id}`, { method: 'PUT' })") == [
        ("axios", "POST", "/api/users", 1),
        ("fetch", "PUT", "/api/x/${id}", 2),
    ]
    assert code.routes("Route::get('/users/{id}', [C::class, 'show']);")[0][:2] == ("GET", "/users/{id}")
    assert code.suites("describe('a', () => { it('b', f) })") == [("suite", "a", 1), ("case", "b", 1)]
    assert code.godot_scene('[node name="Root" type="Node2D"]\n[node name="Kid" type="Sprite" parent="."]')[1]["parent"] == "."
    assert code.manifest('{"dependencies": {"vue": "^3"}}') == [("dependencies", "vue", "^3")]
    assert code.manifest("no json") == [] and code.symbols("", "php") == [] and code.symbols("x", None) == []


def test_tables_take_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (None, "php", "<?php function f() {}"), (2, "odd", "x")], "file_id long, language string, content string")
    assert [(r.file_id, r.name) for r in code.parsed_symbols(df).collect()] == [(None, "f")]


def test_directory_scan(spark, tmp_path):
    import os

    tree, other = tmp_path / "tree", tmp_path / "other"
    for path, text in (("src/a.ts", "a"), ("src/b.min.js", "b"), ("node_modules/c.js", "c"), ("src/d.txt", "d"), ("src/.hidden/e.ts", "e"), ("lib/f.php", "f"), ("lib/keep.ts", "g")):
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(text)
    other.mkdir()
    (other / "z.ts").write_text("z")
    os.symlink(other, tree / "out")
    got = code.scan_directory(spark, str(tree), [".ts", "js", "php"], ignore=["# a remark", "*.min.js", "!keep.ts", "/regex:^lib/k/"]).collect()
    assert sorted((r.relative, r.language, r.content) for r in got) == [("lib/f.php", "php", "f"), ("src/a.ts", "typescript", "a")]
    assert [r.relative for r in code.scan_directory(spark, str(tree), ["ts", "js"], most=1).collect()] == ["lib/keep.ts"]


def test_bytes_and_encodings(spark):
    from symloom.sources import frameworks as W

    assert W.decoded("é".encode("utf-8")) == ("é", "utf-8") and W.decoded(b"\xef\xbb\xbfa") == ("a", "utf-8")
    assert W.decoded("é".encode("cp1252")) == ("é", "cp1252") and W.decoded("ab".encode("utf-16-le")) == ("ab", "utf-16-le")
    assert W.decoded(b"\xff\xfea\x00") == ("a", "utf-16-le") and W.decoded(b"") == ("", "utf-8")
    df = spark.createDataFrame([(1, "\ufeffa\r\nb\rc\n"), (2, None)], "id long, t string")
    assert [r[0] for r in df.orderBy("id").select(W.normalised(code.F.col("t"))).collect()] == ["a\nb\nc\n", None]


def test_packed_payloads(spark):
    from symloom.sources import writing

    df = spark.createDataFrame([(1, "x" * 20_000), (2, "short"), (3, None), (4, "")], "id long, t string")
    packed = writing.packed(df, "t")
    assert {r.id: r.is_packed for r in packed.collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.id: r.t for r in writing.unpacked(packed, "t").collect()} == {1: "x" * 20_000, 2: "short", 3: None, 4: ""}
    assert max(len(r.payload) for r in packed.where("is_packed").collect()) < 200
    assert writing.insert_ignore(df.unionByName(df), "id").count() == 4
