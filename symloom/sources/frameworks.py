"""What frameworks declare in source texts: components, pages, routes, entities, jobs, suites, packages, scenes.

Rows come from the masked text (comments and insides of strings blanked) where
names are looked for, and from the text itself where strings are, at the places
the masked text gives. Each function takes one text and gives tuples; the tables
run them in Arrow batches over all texts.

Defined cases: null and blank texts give no rows; texts of another language give
no rows; what a text computes while it runs is not known.
"""

from __future__ import annotations

import bisect
import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.sources import code
from symloom.session import spread

_COMPONENT = re.compile(r"\b(?:export\s+(?:default\s+)?)?(?:function\s+([A-Z]\w*)\s*\(([^)]*)\)|(?:const|let)\s+([A-Z]\w*)\s*(?::[^=]+)?=\s*(?:(?:React\.)?(?:memo|forwardRef)\s*\(\s*)?(?:async\s*)?\(?([^=)]*)\)?\s*=>|class\s+([A-Z]\w*)\s+extends\s+(?:React\.)?(?:Pure)?Component\b)")
_HOOK = re.compile(r"(?<![\w.$])(use[A-Z]\w*)\s*(?:<[^>()]*>)?\(")
_PARTS = re.compile(r"<([A-Z][\w.]*)")
_STORE = re.compile(r"\bdefineStore\s*\(\s*['\"]([\w-]+)['\"]|\bcreateSlice\s*\(\s*\{\s*name\s*:\s*['\"]([\w-]+)['\"]|\b(create)Store\s*\(")
_COMPOSABLE = re.compile(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\s+(use[A-Z]\w*)|const\s+(use[A-Z]\w*)\s*=)")
_PROVIDED = re.compile(r"\b(provide|inject)\s*\(\s*(?:['\"]([\w:-]+)['\"]|(\w+))")
_GROUP = re.compile(r"\bRoute::(?:(prefix|middleware|name|controller)\(([^)]*)\)(?:\s*->\s*\w+\([^)]*\))*\s*->\s*group|group\(\s*\[([^\]]*)\])")
_RESOURCE = re.compile(r"\bRoute::(apiResource|resource)\(\s*['\"]([^'\"]+)['\"]\s*,\s*\\?([\w\\]+)::class")
#: Actions of a resource route: (method, path after the resource, action) (fixed values of the framework).
RESOURCE_ACTIONS = (
    ("GET", "", "index"), ("GET", "/create", "create"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("GET", "/{id}/edit", "edit"), ("PUT", "/{id}", "update"), ("DELETE", "/{id}", "destroy"),
)
_MIDDLEWARE = re.compile(r"\b(app|router|server|fastify)\.(use|register|addHook)\s*\(\s*(?:(['\"`])([^'\"`]*)\3\s*,\s*)?([\w.$]+)?")
_LARAVEL = re.compile(r"\bclass\s+(\w+)(?:\s+extends\s+\\?([\w\\]+))?(?:\s+implements\s+([\w\\,\s]+?))?\s*\{")
_RELATION = re.compile(r"\bfunction\s+(\w+)\s*\([^)]*\)[^{;]*\{\s*return\s+\$this->(hasOne|hasMany|belongsTo|belongsToMany|morphTo|morphMany|morphOne|hasManyThrough)\s*\(\s*(?:\\?([\w\\]+)::class)?")
_PRISMA = re.compile(r"^model\s+(\w+)\s*\{(.*?)^\}", re.M | re.S)
_PRISMA_FIELD = re.compile(r"^\s+(\w+)\s+(\w+)(\[\])?(\?)?([^\n]*)$", re.M)
_PRISMA_TYPES = frozenset("String Int BigInt Float Decimal Boolean DateTime Json Bytes".split())
_TYPEORM = re.compile(r"@Entity\s*\(([^)]*)\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)")
_TYPEORM_LINK = re.compile(r"@(OneToOne|OneToMany|ManyToOne|ManyToMany)\s*\(\s*\(?\w*\)?\s*=>\s*(\w+)[^;]*?\)\s*(?:@\w+\([^)]*\)\s*)*(?:(?:public|private|readonly)\s+)*(\w+)")
_SEQUELIZE = re.compile(r"\b\w+\.define\s*\(\s*['\"](\w+)['\"]|\bclass\s+(\w+)\s+extends\s+Model\b")
_SEQUELIZE_LINK = re.compile(r"\b(\w+)\.(hasOne|hasMany|belongsTo|belongsToMany)\s*\(\s*(?:models\.)?(\w+)")
_MONGOOSE = re.compile(r"\b(?:mongoose\.)?model\s*(?:<[^>]*>)?\(\s*['\"](\w+)['\"]")
_MONGOOSE_LINK = re.compile(r"\b(\w+)\s*:\s*\[?\s*\{[^{}]*\bref\s*:\s*['\"](\w+)['\"]")
_QUEUE = re.compile(r"\bnew\s+(Queue|Bull|BeeQueue|Worker|QueueScheduler|FlowProducer|Agenda)\s*(?:<[^>]*>)?\(\s*(?:['\"`]([^'\"`]+)['\"`])?|\b(kue)\.createQueue\s*\(")
_PROCESS = re.compile(r"\b(\w+)\.(process|add|define|every|schedule|now|create)\s*\(\s*['\"`]([^'\"`]+)['\"`]")
_CONSTANT = re.compile(r"\b(?:const|let|var|static|readonly)\s+(\w+)\s*(?::\s*string\s*)?=\s*(['\"`])([^'\"`\n]*)\2")
_API = re.compile(r"\b(?P<client>axios|\$?fetch|http|api|\$http|request|useFetch|ky|got)(?:\.(?P<verb>get|post|put|patch|delete))?\s*(?:<[^>]*>)?\(\s*(?P<arg>[^,)\n]+)(?P<rest>[^)\n]{0,200})")
_SUITE_ASSERT = re.compile(r"\bexpect\s*\(|\bassert\w*\s*[.(]|->assert\w+\(|\bAssert\.\w+\(|\.Should\(\)")
_MOCK = re.compile(r"\b(?:jest|vi|sinon)\.(?:mock|fn|spyOn|stub)\s*\(|\bMockery::mock|\bnew\s+Mock<")
_SIGNAL = re.compile(r"\[Signal\]\s*(?:public\s+)?delegate\s+void\s+(\w+)|^signal\s+(\w+)", re.M)
_EMIT = re.compile(r"\bEmitSignal\s*\(\s*(?:SignalName\.)?[\"']?(\w+)|\b(\w+)\.emit\s*\(|\bemit_signal\s*\(\s*['\"](\w+)")
_CONNECT = re.compile(r"\b(\w+)\.Connect\s*\(\s*[\"']?(\w+)|\b(\w+)\.(\w+)\.connect\s*\(")
_EXTERNAL_RESOURCE = re.compile(r"^\[ext_resource\s+([^\]]*)\]", re.M)
_AUTOLOAD = re.compile(r"^\[autoload\]\s*$(.*?)(?=^\[|\Z)", re.M | re.S)


def _line(lines: list[int], at: int) -> int:
    return bisect.bisect_right(lines, at)


def react_components(text: str) -> list[tuple[str, str, list[str], list[str], list[str], int]]:
    """Components as (name, kind, props, hooks, parts, line): functions and classes that give elements."""
    bare = code.masked(text)
    lines, ends = code._lines(bare), code._brackets(bare)
    out = []
    for m in _COMPONENT.finditer(bare):
        name = m[1] or m[3] or m[5]
        open_ = bare.find("{", m.end())
        stop = ends.get(open_, len(bare)) if open_ >= 0 else len(bare)
        inside = bare[m.end() : stop + 1]
        if not m[5] and not re.search(r"<[A-Za-z>]", inside):
            continue
        given = m[2] if m[1] else m[4]
        props = re.findall(r"(\w+)\s*(?:=[^,}]*)?(?=[,}])", given[given.find("{") : given.find("}") + 1]) if given and "{" in given else []
        out.append((name, "class" if m[5] else "function", list(dict.fromkeys(props)), list(dict.fromkeys(_HOOK.findall(inside))), list(dict.fromkeys(_PARTS.findall(inside))), _line(lines, m.start())))
    return out


def composables(text: str) -> list[tuple[str, str, int]]:
    """Stores, composables, provided and injected keys as (kind, name, line)."""
    lines = code._lines(text)
    out = [("store", m[1] or m[2] or "store", _line(lines, m.start())) for m in _STORE.finditer(text)]
    out += [("composable", m[1] or m[2], _line(lines, m.start())) for m in _COMPOSABLE.finditer(text)]
    out += [(m[1], m[2] or m[3], _line(lines, m.start())) for m in _PROVIDED.finditer(text)]
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def next_page(path: str, text: str) -> list[tuple[str, str, str]]:
    """Route of a file in a pages or app folder, as (kind, route, method)."""
    m = re.search(r"(?:^|/)(?:src/)?(pages|app)/(.*)\.(?:jsx?|tsx?)$", path)
    if not m:
        return []
    kind, rest = m[1], m[2]
    exported = re.findall(r"\bexport\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", code.masked(text))
    if kind == "app":
        folder, leaf = posixpath.split(rest)
        what = {"page": "page", "route": "api", "layout": "layout", "loading": "loading", "error": "error"}.get(leaf)
        if what is None:
            return []
        rest = "/".join(p for p in folder.split("/") if not re.fullmatch(r"\(.*\)", p))
    else:
        if posixpath.basename(rest).startswith("_"):
            return [(posixpath.basename(rest)[1:], "", "")]
        what = "api" if rest.startswith("api/") else "page"
        rest = re.sub(r"(?:^|/)index$", "", rest)
    route = "/" + re.sub(r"\[\[?\.\.\.(\w+)\]?\]", r"{\1*}", rest)
    route = re.sub(r"\[(\w+)\]", r"{\1}", route)
    return [(what, route, verb) for verb in (exported if what == "api" and exported else [""])]


def middlewares(text: str) -> list[tuple[str, str, str | None, str | None, int]]:
    """Uses of middleware and plugins as (object, verb, path, what, line)."""
    lines = code._lines(text)
    return [(m[1], m[2], m[4], m[5], _line(lines, m.start())) for m in _MIDDLEWARE.finditer(text)]


def _string(value: str) -> str:
    found = re.search(r"['\"]([^'\"]*)['\"]", value or "")
    return found[1] if found else ""


def _argument(text: str) -> str:
    """What stands before the bracket that closes the call."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if depth < 0:
            return text[:i].strip()
    return text.strip()


def laravel_routes(text: str) -> list[tuple[str, str, str | None, str, int]]:
    """Routes with the prefixes and middleware of their groups, resources unfolded: (method, path, handler, middleware, line)."""
    bare = code.masked(text)
    lines, ends = code._lines(bare), code._brackets(bare)
    groups = []
    for m in _GROUP.finditer(text):
        open_ = bare.find("{", m.end() if m[1] is None else text.find("group", m.start()))
        head = m[0] if m[1] else (m[3] or "")
        prefix = re.search(r"prefix\(\s*['\"]([^'\"]*)|['\"]prefix['\"]\s*=>\s*['\"]([^'\"]*)", head)
        ware = re.search(r"middleware\(\s*([^)]*)|['\"]middleware['\"]\s*=>\s*(\[[^\]]*\]|['\"][^'\"]*['\"])", head)
        groups.append((open_, ends.get(open_, len(text)), (prefix[1] or prefix[2]) if prefix else "", ",".join(re.findall(r"['\"]([^'\"]+)['\"]", (ware[1] or ware[2]) if ware else ""))))
    found = [(m, m["a"].upper(), m["u1"], m["h1"]) for m in code._ROUTES.finditer(text) if m["a"]]
    for m in _RESOURCE.finditer(text):
        found += [(m, verb, m[2] + rest, f"[{m[3]}::class, '{action}']") for verb, rest, action in RESOURCE_ACTIONS if m[1] == "resource" or action not in ("create", "edit")]
    out = []
    for m, verb, url, handler in found:
        around = [g for g in groups if g[0] <= m.start() < g[1]]
        path = "/" + "/".join(p.strip("/") for p in [*[g[2] for g in around], url] if p.strip("/"))
        own = re.search(r"->middleware\(\s*([^)]*)\)", text[m.start() : text.find(";", m.start()) if ";" in text[m.start() :] else len(text)])
        ware = [g[3] for g in around if g[3]] + ([_string(own[1])] if own else [])
        out.append((verb, path, _argument(handler) if handler else None, ",".join(ware), _line(lines, m.start())))
    return sorted(out, key=lambda x: (x[4], x[1], x[0]))


def laravel_classes(text: str) -> list[tuple[str, str, str, str | None, str | None]]:
    """Models, controllers, jobs and the like with the relations of models: (class, kind, member, relation, target)."""
    bare = code.masked(text)
    ends = code._brackets(bare)
    out = []
    for m in _LARAVEL.finditer(bare):
        name, base, faces = m[1], (m[2] or "").rsplit("\\", 1)[-1], m[3] or ""
        kind = (
            "model" if base in ("Model", "Authenticatable", "Pivot") else "controller" if base == "Controller" or name.endswith("Controller") else "job" if "ShouldQueue" in faces or name.endswith("Job")
            else "request" if base == "FormRequest" else "resource" if base in ("JsonResource", "ResourceCollection") else "command" if base == "Command" else "notification" if base == "Notification"
            else "provider" if base == "ServiceProvider" else "mailable" if base == "Mailable" else "event" if name.endswith("Event") else "middleware" if name.endswith("Middleware") else ""
        )
        if not kind:
            continue
        open_ = bare.find("{", m.end() - 1)
        inside = bare[open_ : ends.get(open_, len(bare))]
        links = [(r[1], r[2], (r[3] or "").rsplit("\\", 1)[-1] or None) for r in _RELATION.finditer(inside)] if kind == "model" else []
        out += [(name, kind, *link) for link in links] or [(name, kind, "", None, None)]
    return out


def orm_entities(text: str) -> list[tuple[str, str, str, str | None, str | None]]:
    """Entities of object mappers with their fields that link to others: (library, entity, field, relation, target)."""
    out: list[tuple] = []
    for m in _PRISMA.finditer(text):
        fields = [(f[1], "many" if f[3] else "one", f[2]) for f in _PRISMA_FIELD.finditer(m[2]) if f[2] not in _PRISMA_TYPES and f[2][:1].isupper()]
        out += [("prisma", m[1], *f) for f in fields] or [("prisma", m[1], "", None, None)]
    bare = text
    places = [(m.start(), "typeorm" if "typeorm" in text or "mikro-orm" not in text else "mikroorm", m[2]) for m in _TYPEORM.finditer(bare)]
    for i, (at, library, name) in enumerate(places):
        stop = places[i + 1][0] if i + 1 < len(places) else len(bare)
        links = [(x[3], x[1], x[2]) for x in _TYPEORM_LINK.finditer(bare[at:stop])]
        out += [(library, name, *x) for x in links] or [(library, name, "", None, None)]
    if re.search(r"sequelize", text, re.I):
        links = {}
        for x in _SEQUELIZE_LINK.finditer(text):
            links.setdefault(x[1], []).append(("", x[2], x[3]))
        for m in _SEQUELIZE.finditer(text):
            name = m[1] or m[2]
            out += [("sequelize", name, *x) for x in links.get(name, [])] or [("sequelize", name, "", None, None)]
    elif re.search(r"\bobjection\b", text):
        out += [("objection", m[1], "", None, None) for m in re.finditer(r"\bclass\s+(\w+)\s+extends\s+Model\b", text)]
    if re.search(r"mongoose", text):
        links = [(x[1], "ref", x[2]) for x in _MONGOOSE_LINK.finditer(text)]
        for m in _MONGOOSE.finditer(text):
            out += [("mongoose", m[1], *x) for x in links] or [("mongoose", m[1], "", None, None)]
    return out


def jobs(text: str) -> list[tuple[str, str, str | None, int]]:
    """Queues, workers and the jobs put in or taken from them: (kind, library, name, line)."""
    lines = code._lines(text)
    library = next((x for x in ("bullmq", "bull", "agenda", "bee-queue", "kue") if re.search(rf"['\"]{x}['\"]", text)), None)
    out = []
    for m in _QUEUE.finditer(text):
        kind = "worker" if m[1] == "Worker" else "queue"
        if m[1] == "Worker" and library is None:
            library_ = "worker_threads"
        else:
            library_ = library or ("kue" if m[3] else (m[1] or "").lower())
        out.append((kind, library_, m[2], _line(lines, m.start())))
    if library or out:
        kinds = {"process": "processor", "define": "processor", "add": "job", "every": "schedule", "schedule": "schedule", "now": "job", "create": "job"}
        out += [(kinds[m[2]], library or "", m[3], _line(lines, m.start())) for m in _PROCESS.finditer(text)]
    return sorted(out, key=lambda x: (x[3], x[0], x[2] or ""))


def test_suites(text: str) -> list[tuple[str, str, int, int, int]]:
    """Suites and cases with their assertions and mocks: (kind, title, line, assertions, mocks)."""
    lines = code._lines(text)
    found = list(code._SUITE.finditer(text))
    out = []
    for i, m in enumerate(found):
        stop = found[i + 1].start() if i + 1 < len(found) else len(text)
        part = text[m.start() : stop]
        out.append(("suite" if m[1] == "describe" else "case", m[3] or m[4] or m[5], _line(lines, m.start()), len(_SUITE_ASSERT.findall(part)), len(_MOCK.findall(part))))
    return out


def api_calls(text: str) -> list[tuple[str, str, str, int]]:
    """HTTP calls as (client, method, URL, line); constants that a URL is made of are put in, other names stand as {name}."""
    lines = code._lines(text)
    known: dict[str, str] = {}

    def value(part: str) -> str:
        part = part.strip()
        if part[:1] in "'\"`" and part[-1:] == part[:1]:
            return re.sub(r"\$\{\s*([^}]*?)\s*\}", lambda m: known.get(m[1].rsplit(".", 1)[-1], "{" + m[1].rsplit(".", 1)[-1] + "}"), part[1:-1])
        name = part.rsplit(".", 1)[-1]
        return known.get(name, "{" + name + "}" if re.fullmatch(r"\w+", name) else "")

    for m in _CONSTANT.finditer(text):
        known[m[1]] = value(m[2] + m[3] + m[2])
    out = []
    for m in _API.finditer(text):
        parts = re.split(r"\s*\+\s*", m["arg"])
        url = "".join(map(value, parts))
        written = any(p.strip()[:1] in "'\"`" for p in parts) or m["arg"].strip().rsplit(".", 1)[-1] in known
        if not written or "/" not in url:
            continue
        verb = m["verb"] or (re.search(r"method\s*:\s*['\"](\w+)", m["rest"]) or [None, "get"])[1]
        out.append((m["client"], verb.upper(), url, _line(lines, m.start())))
    return out


def call_contexts(text: str, language: str) -> list[tuple[str | None, str, str, list[str], int]]:
    """Calls with their arguments: (enclosing symbol, callee, arguments as written, kinds of the arguments, line)."""
    if not code.family(language) or not text:
        return []
    script = code._script_of(text, language)
    bare = code.masked(script)
    lines = code._lines(bare)
    around = [s for s in code.symbols(text, language) if s["symbol_type"] in ("function", "method") and s["end"] > s["start"]]
    heads = {s["start"] for s in around}
    out = []
    for m in code._CALL.finditer(bare):
        if m[2] in code._NOT_NAMES or m.start(2) in heads or code.DECLARES.search(bare, max(0, m.start() - 80), m.start()):
            continue
        depth, at, cuts = 0, m.end() - 1, [m.end()]
        while at < len(bare):
            c = bare[at]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    break
            elif c == "," and depth == 1:
                cuts.append(at + 1)
            at += 1
        parts = [" ".join(script[a : b - 1].split()) for a, b in zip(cuts, [*cuts[1:], at + 1], strict=True)]
        parts = [p for p in parts if p]
        inside = [s for s in around if s["start"] < m.start() <= s["end"]]
        out.append((inside[-1]["name"] if inside else None, m[2], f"({', '.join(parts)})", [_kind(p) for p in parts], _line(lines, m.start())))
    return out


def _kind(argument: str) -> str:
    if argument[:1] in "'\"`":
        return "string"
    if re.fullmatch(r"-?\d[\d_]*n?", argument):
        return "int"
    if re.fullmatch(r"-?\d[\d_.eE+-]*[fFdDmM]?", argument):
        return "float"
    if argument in ("true", "false"):
        return "bool"
    if argument in ("null", "undefined", "nil"):
        return "null"
    if argument[:1] == "[":
        return "array"
    if argument[:1] == "{":
        return "object"
    if re.match(r"new\s+([\w.\\]+)", argument):
        return re.match(r"new\s+([\w.\\]+)", argument)[1]
    if "=>" in argument or argument.startswith(("function", "fn")):
        return "function"
    return "expression"


def godot(path: str, text: str) -> list[tuple[str, str, str | None, str | None]]:
    """Scenes, their nodes and scripts, signals and autoloads: (kind, name, type or signal, parent or path)."""
    out: list[tuple] = []
    if path.endswith(".tscn"):
        pairs = [{a: b or c for a, b, c in code._PAIR.findall(m[1])} for m in _EXTERNAL_RESOURCE.finditer(text)]
        out += [("resource", p.get("id", ""), p.get("type"), p.get("path")) for p in pairs]
        out += [("node", n.get("name", ""), n.get("type"), n.get("parent")) for n in code.godot_scene(text)]
    elif path.endswith("project.godot"):
        for m in _AUTOLOAD.finditer(text):
            out += [("autoload", a, None, b.lstrip("*")) for a, b in re.findall(r"^(\w+)=\"([^\"]*)\"", m[1], re.M)]
    else:
        out += [("signal", m[1] or m[2], None, None) for m in _SIGNAL.finditer(text)]
        out += [("emit", next(g for g in m.groups() if g), None, None) for m in _EMIT.finditer(text)]
        out += [("connect", m[1] or m[3], m[2] or m[4], None) for m in _CONNECT.finditer(text)]
    return out


#: Packages that tell a framework (fixed values).
FRAMEWORK_PACKAGES = {
    "vue": "vue", "nuxt": "vue", "react": "react", "react-dom": "react", "next": "nextjs", "express": "node", "fastify": "node", "koa": "node", "@nestjs/core": "node", "laravel/framework": "laravel",
    "@prisma/client": "prisma", "typeorm": "typeorm", "sequelize": "sequelize", "mongoose": "mongoose", "bullmq": "bullmq", "bull": "bull", "jest": "jest", "vitest": "vitest", "cypress": "cypress", "@playwright/test": "playwright", "phpunit/phpunit": "phpunit",
}


def framework_evidence(path: str, text: str) -> list[tuple[str, str]]:
    """Frameworks that a file speaks for, with why: its manifest, its name or its code."""
    name = posixpath.basename(path)
    if name in ("package.json", "composer.json"):
        return sorted({(FRAMEWORK_PACKAGES[n], "manifest") for _, n, _ in code.manifest(text) if n in FRAMEWORK_PACKAGES})
    out = set()
    if name.endswith(".vue"):
        out.add(("vue", "file"))
    if name == "artisan" or re.search(r"(?:^|/)(?:app/Http/Controllers|app/Models|routes/(?:web|api)\.php)", path):
        out.add(("laravel", "folder"))
    if name == "project.godot" or name.endswith((".tscn", ".gd")):
        out.add(("godot", "file"))
    if re.search(r"(?:^|/)next\.config\.", path):
        out.add(("nextjs", "file"))
    if re.search(r"\bfrom\s+['\"]react['\"]|require\(\s*['\"]react['\"]", text):
        out.add(("react", "code"))
    if re.search(r"\bfrom\s+['\"](?:vue|pinia|vue-router)['\"]", text):
        out.add(("vue", "code"))
    if re.search(r"(?:from\s+|require\(\s*)['\"](?:express|fastify|koa)['\"]", text):
        out.add(("node", "code"))
    if re.search(r"\buse\s+Illuminate\\", text):
        out.add(("laravel", "code"))
    if re.search(r"^\s*using\s+Godot\b", text, re.M):
        out.add(("godot", "code"))
    return sorted(out)


def _encoding(text: str) -> tuple[str, bool, str, float]:
    """Kind of encoding, byte-order mark, line ends and share of characters beyond ASCII of a decoded text."""
    beyond = sum(ord(c) > 127 for c in text)
    broken = text.count("�")
    kind = "binary" if "\x00" in text else "damaged" if broken else "ascii" if not beyond else "latin" if all(ord(c) < 256 for c in text) else "utf-8"
    crlf, lf = text.count("\r\n"), text.count("\n")
    ends = "none" if not lf else "crlf" if crlf == lf else "lf" if not crlf else "mixed"
    return kind, text.startswith("﻿"), ends, round(beyond / max(1, len(text)), 6)


def normalised(text: Column) -> Column:
    """A text without byte-order mark, with line feeds only."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def decoded(data: bytes) -> tuple[str, str]:
    """Bytes as (text, encoding): by mark, else UTF-8 where that fits, else the western code page."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    if data.count(0) > len(data) // 4:
        name = "utf-16-le" if data[1::2].count(0) > data[::2].count(0) else "utf-16-be"
        return data.decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace"), "cp1252"


def rows_of(sources: DataFrame, rows: Callable[[str, str, str], list[tuple]], schema: str, where: Column | str | None = None) -> DataFrame:
    """A table of what a function gives for (path, text, language) of every text: file_id and the schema's columns."""
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file_id, path, language, text in zip(pdf["file_id"], pdf["path"], pdf["language"], pdf["content"], strict=True):
                if isinstance(text, str):
                    out += [(file_id, *r) for r in rows(path if isinstance(path, str) else "", text, language if isinstance(language, str) else "")]
            yield pd.DataFrame({"file_id": pd.array([r[0] for r in out], "Int64"), **{n: pd.Series([r[i + 1] for r in out], dtype=object) for i, n in enumerate(names)}})

    df = sources if where is None else sources.where(where)
    base = df.select(F.col("file_id").cast("long"), F.col("path").cast("string"), F.col("language").cast("string"), F.col("content").cast("string"))
    return spread(base).mapInPandas(run, f"file_id long, {schema}")
