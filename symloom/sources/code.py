"""Symbols, imports, exports, calls and routes out of source texts, as table functions.

A text is masked first: comments and the insides of strings become blanks of the
same length, so offsets and lines stay, and brackets in them do not count. The
rows then come from declarations found in the masked text and from matching
brackets. Covered are JavaScript, TypeScript, PHP, C# and Vue components, HTTP
calls and routes of common libraries, scenes of the Godot text format, package
manifests and test suites. Types, dynamic names and macros are not resolved.

Defined cases: null and blank texts give no rows; unbalanced brackets end a
symbol at its own line; unknown languages give no rows.
"""

from __future__ import annotations

import bisect
import json
import os
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.session import spread

_MASKED = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|(?<![\w$&])#(?![\[\w!])[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_DECLARED = {
    "script": [
        ("class", re.compile(r"\b(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s*<[^{>]*>)?(?:\s+extends\s+([\w$.]+))?")),
        ("interface", re.compile(r"\binterface\s+([A-Za-z_$][\w$]*)(?:\s*<[^{>]*>)?(?:\s+extends\s+([\w$.]+))?\s*\{")),
        ("enum", re.compile(r"\benum\s+([A-Za-z_$][\w$]*)()\s*\{")),
        ("type_alias", re.compile(r"\btype\s+([A-Za-z_$][\w$]*)(?:<[^=]*>)?\s*=()")),
        ("function", re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)()\s*(?:<[^(]*>)?\(")),
        ("function", re.compile(r"\bconst\s+([A-Za-z_$][\w$]*)()\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)")),
        ("method", re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|override|get|set|readonly|abstract)\s+)*\*?\s*#?([A-Za-z_$][\w$]*)()\s*(?:<[^(\n]*>)?\([^{};]*\)\s*(?::[^{};=]+)?\{", re.M)),
    ],
    "php": [
        ("namespace", re.compile(r"\bnamespace\s+([\w\\]+)()\s*[;{]")),
        ("class", re.compile(r"\bclass\s+(\w+)(?:\s+extends\s+([\w\\]+))?")),
        ("interface", re.compile(r"\binterface\s+(\w+)(?:\s+extends\s+([\w\\]+))?")),
        ("trait", re.compile(r"\btrait\s+(\w+)()")),
        ("enum", re.compile(r"\benum\s+(\w+)()\s*(?::\s*\w+\s*)?\{")),
        ("function", re.compile(r"\bfunction\s+&?\s*(\w+)()\s*\(")),
    ],
    "csharp": [
        ("namespace", re.compile(r"\bnamespace\s+([\w.]+)()\s*[;{]")),
        ("class", re.compile(r"\b(?:class|record|struct)\s+(\w+)(?:\s*<[^{>]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*([\w.]+))?")),
        ("interface", re.compile(r"\binterface\s+(\w+)(?:\s*<[^{>]*>)?(?:\s*:\s*([\w.]+))?")),
        ("enum", re.compile(r"\benum\s+(\w+)()")),
        ("method", re.compile(r"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract|partial|extern|new)\s+)+(?:[\w<>\[\],.?() ]+\s+)?(\w+)()\s*(?:<[^(\n]*>)?\([^;{}]*\)\s*(?:where[^{]*)?(?:\{|=>)", re.M)),
    ],
}
_NOT_NAMES = frozenset("if for while switch catch return function constructor_ new else do try typeof await foreach using lock".split())
_IMPORTS = {
    "script": re.compile(r"\bimport\s+(?:type\s+)?(?:(?P<what>[\w*{}\s,$]+?)\s+from\s+)?['\"](?P<a>[^'\"\n]+)['\"]|\brequire\(\s*['\"](?P<b>[^'\"\n]+)['\"]\s*\)|\bimport\(\s*['\"](?P<c>[^'\"\n]+)['\"]\s*\)"),
    "php": re.compile(r"^\s*use\s+(?:function\s+|const\s+)?(?P<a>[\w\\]+)(?:\s+as\s+(?P<what>\w+))?\s*;", re.M),
    "csharp": re.compile(r"^\s*using\s+(?:static\s+)?(?:(?P<what>\w+)\s*=\s*)?(?P<a>[\w.]+)\s*;", re.M),
}
_EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:class|function\*?|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)|\bexport\s*\{([^}]*)\}|\bmodule\.exports\s*=\s*\{([^}]*)\}")
_CALL = re.compile(r"(?<![\w$.>:])((?:[\w$]+(?:\.|->|::|\?\.|\?->))*)([A-Za-z_][\w$]*)\s*\(")
#: A declaration that looks like a call of the name after it.
DECLARES = re.compile(r"\bdelegate\s+[\w<>\[\],.?]+\s+\Z")
_HTTP = re.compile(
    r"\b(?P<client>axios|\$?fetch|http|api|\$http|request|useFetch)(?:\.(?P<verb>get|post|put|patch|delete))?\s*(?:<[^>]*>)?\(\s*(?P<q>['\"`])(?P<url>[^'\"`\n]*)(?P=q)(?P<rest>[^)\n]{0,200})"
)
_ROUTES = re.compile(
    r"\bRoute::(?P<a>get|post|put|patch|delete|any)\(\s*['\"](?P<u1>[^'\"]*)['\"]\s*,\s*(?P<h1>[^;\n]*)|\b(?:app|router|server|fastify)\.(?P<b>get|post|put|patch|delete)\(\s*['\"`](?P<u2>[^'\"`]*)['\"`]\s*,\s*(?P<h2>[\w.$]*)|\[Http(?P<c>Get|Post|Put|Patch|Delete)(?:\(\s*\"(?P<u3>[^\"]*)\"\s*\))?\]"
)
_SUITE = re.compile(r"\b(describe|it|test)(?:\.(?:only|skip|each))?\s*\(\s*(['\"`])((?:[^'\"`\\\n]|\\.)*)\2|\bfunction\s+(test\w+)\s*\(|\[(?:Fact|Test|Theory)\]\s*(?:public\s+)?(?:async\s+)?[\w<>]+\s+(\w+)\s*\(")
_NODE = re.compile(r"^\[node\s+([^\]]*)\]", re.M)
_PAIR = re.compile(r"(\w+)=(?:\"([^\"]*)\"|([^\s\]]+))")


def masked(text: str) -> str:
    """The text with comments and the insides of strings blanked, line feeds kept."""

    def blank(m: re.Match) -> str:
        s = m[0]
        body = re.sub(r"[^\n]", " ", s)
        return s[0] + body[1:-1] + s[-1] if s[0] in "\"'`" and len(s) > 1 else body

    return _MASKED.sub(blank, text)


def family(language: str | None) -> str:
    return {"javascript": "script", "typescript": "script", "vue": "script", "php": "php", "csharp": "csharp"}.get((language or "").strip().lower(), "")


def _script_of(text: str, language: str) -> str:
    """Vue components with everything outside script blocks blanked."""
    if (language or "").lower() != "vue":
        return text
    out, at = [], 0
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script\s*>", text, re.S | re.I):
        out += [re.sub(r"[^\n]", " ", text[at : m.start(1)]), m[1]]
        at = m.end(1)
    out.append(re.sub(r"[^\n]", " ", text[at:]))
    return "".join(out)


def _brackets(text: str) -> dict[int, int]:
    stack, out = [], {}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _lines(text: str) -> list[int]:
    return [0, *[m.end() for m in re.finditer("\n", text)]]


def symbols(text: str, language: str) -> list[dict]:
    """Declared symbols with lines, parent, export mark, base and signature."""
    kind = family(language)
    if not kind or not text:
        return []
    code = _script_of(text, language)
    bare = masked(code)
    lines, ends = _lines(bare), _brackets(bare)
    found, seen = [], set()
    for symbol_type, rule in _DECLARED[kind]:
        for m in rule.finditer(bare):
            at = m.start(1)
            if at in seen or m[1] in _NOT_NAMES:
                continue
            seen.add(at)
            open_ = bare.find("{", m.end(1) if symbol_type not in ("method",) else m.end() - 1)
            stop = bare.find(";", m.end(1))
            body = open_ if open_ >= 0 and (stop < 0 or open_ < stop or symbol_type == "function") else -1
            end = ends.get(body, -1)
            found.append(
                {
                    "name": m[1],
                    "symbol_type": symbol_type,
                    "base_class": m[2] or None,
                    "start": at,
                    "end": end if end > 0 else at,
                    "start_line": bisect.bisect_right(lines, at),
                    "end_line": bisect.bisect_right(lines, end if end > 0 else at),
                    "is_exported": bool(re.search(r"\b(?:export|public)\b[^;{}]*$", bare[max(0, at - 80) : at])),
                    "signature": " ".join(code[m.start() : body if body > 0 else m.end()].split()),
                }
            )
    found.sort(key=lambda x: (x["start"], -x["end"]))
    open_: list[dict] = []
    for x in found:
        while open_ and open_[-1]["end"] < x["start"]:
            open_.pop()
        holder = next((o for o in reversed(open_) if o["symbol_type"] in ("class", "interface", "trait", "enum")), None)
        x["parent"] = holder["name"] if holder else None
        if holder and x["symbol_type"] == "function":
            x["symbol_type"] = "method"
        if x["end"] > x["start"]:
            open_.append(x)
    return found


def imports(text: str, language: str) -> list[tuple[str, str | None, str, int]]:
    """Imported sources with the imported names, the kind of import and the line."""
    kind = family(language)
    if not kind or not text:
        return []
    code = re.sub(r"/\*.*?\*/|(?<!:)//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), _script_of(text, language), flags=re.S)
    lines = _lines(code)
    out = []
    for m in _IMPORTS[kind].finditer(code):
        g = m.groupdict()
        source = g.get("a") or g.get("b") or g.get("c")
        how = "require" if g.get("b") else "dynamic" if g.get("c") else "import"
        what = " ".join(g["what"].split()) if g.get("what") else None
        out.append((source, what, how, bisect.bisect_right(lines, m.start())))
    return out


def exports(text: str, language: str) -> list[tuple[str, int]]:
    if family(language) != "script" or not text:
        return []
    bare = masked(_script_of(text, language))
    lines = _lines(bare)
    out = []
    for m in _EXPORT.finditer(bare):
        line = bisect.bisect_right(lines, m.start())
        names = [m[1]] if m[1] else re.split(r"\s*,\s*", (m[2] or m[3] or "").strip())
        out += [(re.split(r"\s+as\s+|\s*:", n)[-1].strip(), line) for n in names if n.strip()]
    return out


def calls(text: str, language: str) -> list[tuple[str | None, str, str, int]]:
    """Calls as (enclosing symbol, calling object, callee, line)."""
    if not family(language) or not text:
        return []
    bare = masked(_script_of(text, language))
    lines = _lines(bare)
    around = [s for s in symbols(text, language) if s["symbol_type"] in ("function", "method") and s["end"] > s["start"]]
    heads = {s["start"] for s in around}
    out = []
    for m in _CALL.finditer(bare):
        if m[2] in _NOT_NAMES or m.start(2) in heads or DECLARES.search(bare, max(0, m.start() - 80), m.start()):
            continue
        inside = [s for s in around if s["start"] < m.start() <= s["end"]]
        out.append((inside[-1]["name"] if inside else None, re.sub(r"(?:\?\.|\?->|\.|->|::)$", "", m[1]), m[2], bisect.bisect_right(lines, m.start())))
    return out


def http_calls(text: str) -> list[tuple[str, str, str, int]]:
    """HTTP calls as (client, method, URL, line)."""
    lines = _lines(text or "")
    out = []
    for m in _HTTP.finditer(text or ""):
        verb = m["verb"] or (re.search(r"method\s*:\s*['\"](\w+)", m["rest"]) or [None, "get"])[1]
        if "/" in m["url"]:
            out.append((m["client"], verb.upper(), m["url"], bisect.bisect_right(lines, m.start())))
    return out


def routes(text: str) -> list[tuple[str, str, str | None, int]]:
    """Declared routes as (method, path, handler, line)."""
    lines = _lines(text or "")
    out = []
    for m in _ROUTES.finditer(text or ""):
        verb = (m["a"] or m["b"] or m["c"]).upper()
        url = m["u1"] if m["a"] else m["u2"] if m["b"] else m["u3"]
        handler = m["h1"] or m["h2"]
        out.append((verb, url or "", handler.strip() if handler else None, bisect.bisect_right(lines, m.start())))
    return out


def suites(text: str) -> list[tuple[str, str, int]]:
    """Test suites and cases as (kind, title, line)."""
    lines = _lines(text or "")
    return [
        ("suite" if m[1] == "describe" else "case", m[3] or m[4] or m[5], bisect.bisect_right(lines, m.start()))
        for m in _SUITE.finditer(text or "")
    ]


def vue_component(text: str) -> dict:
    """Props, emits, slots and used components of a Vue component."""
    script, template = _script_of(text, "vue"), "".join(re.findall(r"<template\b[^>]*>(.*)</template>", text, re.S))
    props = re.search(r"defineProps(?:<\{(?P<t>[^}]*)\}>|\(\s*[\[{](?P<o>[^\]}]*))|\bprops\s*:\s*[\[{](?P<p>[^\]}]*)", script)
    names = re.findall(r"['\"]?(\w+)['\"]?\s*(?:\??:|,|$)", next((g for g in props.groups() if g), "")) if props else []
    return {
        "props": list(dict.fromkeys(names)),
        "emits": list(dict.fromkeys(re.findall(r"\bemit\(\s*['\"]([\w:-]+)", script))),
        "slots": list(dict.fromkeys(re.findall(r"<slot(?:\s+name=\"(\w+)\")?", template))),
        "components": list(dict.fromkeys(re.findall(r"<([A-Z]\w+)", template))),
    }


def godot_scene(text: str) -> list[dict]:
    """Nodes of a scene in Godot's text format with their parent path."""
    return [{a: b or c for a, b, c in _PAIR.findall(m[1])} for m in _NODE.finditer(text or "")]


def manifest(text: str) -> list[tuple[str, str, str]]:
    """Dependencies of a package manifest as (section, name, version); text that is no JSON gives none."""
    try:
        data = json.loads(text)
    except (TypeError, ValueError):
        return []
    if not isinstance(data, dict):
        return []
    return [
        (section, name, str(version))
        for section in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev", "scripts")
        if isinstance(data.get(section), dict)
        for name, version in data[section].items()
    ]


def candidates(path: str, source: str) -> list[str]:
    """Paths that an import may mean, most likely first: as written, with an extension, as a folder's index."""
    if source.startswith("@/"):
        base = "src/" + source[2:]
    elif source.startswith("."):
        base = posixpath.normpath(posixpath.join(posixpath.dirname(path), source))
    else:
        base = source
    if base.startswith(".."):
        return []
    extensions = (".ts", ".tsx", ".js", ".mjs", ".cjs", ".jsx", ".vue")
    return [base, *[base + e for e in extensions], *[f"{base}/index{e}" for e in extensions]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def import_candidates(path: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([candidates(p or "", s or "") for p, s in zip(path, source, strict=True)])


def _table(sources: DataFrame, rows, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file_id, language, text in zip(pdf["file_id"], pdf["language"], pdf["content"], strict=True):
                if isinstance(text, str):
                    out += [(file_id, *r) for r in rows(text, language)]
            yield pd.DataFrame(out, columns=["file_id", *columns]).astype({"file_id": "Int64"})

    base = sources.select(F.col("file_id").cast("long"), F.col("language").cast("string"), F.col("content").cast("string"))
    return spread(base).mapInPandas(run, f"file_id long, {schema}")


def parsed_symbols(sources: DataFrame) -> DataFrame:
    keys = ["name", "symbol_type", "parent", "base_class", "start_line", "end_line", "is_exported", "signature"]
    return _table(
        sources,
        lambda t, lang: [tuple(s[k] for k in keys) for s in symbols(t, lang)],
        keys,
        "name string, symbol_type string, parent string, base_class string, start_line int, end_line int, is_exported boolean, signature string",
    )


def parsed_imports(sources: DataFrame) -> DataFrame:
    return _table(sources, imports, ["source", "names", "import_type", "line_number"], "source string, names string, import_type string, line_number int")


def parsed_exports(sources: DataFrame) -> DataFrame:
    return _table(sources, exports, ["name", "line_number"], "name string, line_number int")


def parsed_calls(sources: DataFrame) -> DataFrame:
    return _table(sources, calls, ["caller", "calling_object", "callee", "line_number"], "caller string, calling_object string, callee string, line_number int")


def parsed_http(sources: DataFrame) -> DataFrame:
    return _table(sources, lambda t, lang: http_calls(t), ["client", "method", "url", "line_number"], "client string, method string, url string, line_number int")


def parsed_routes(sources: DataFrame) -> DataFrame:
    return _table(sources, lambda t, lang: routes(t), ["method", "path", "handler", "line_number"], "method string, path string, handler string, line_number int")


def parsed_components(sources: DataFrame) -> DataFrame:
    def rows(text: str, language: str) -> list[tuple]:
        c = vue_component(text)
        return [(c["props"], c["emits"], c["slots"], c["components"])]

    return _table(
        sources.where(F.lower("language") == "vue"), rows, ["props", "emits", "slots", "components"], "props array<string>, emits array<string>, slots array<string>, components array<string>"
    )


def scan_directory(spark, folder: str, extensions: list[str], most: int | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Files below a folder with an extension of the list: path, relative, content, language, size, last_modified.

    Skipped directories and what the lines of an ignore file exclude are left
    out. Links on a local disk that lead out of the folder are not followed.
    most keeps the first so many by path.
    """
    from symloom.functions.exprs import extension, ignored, in_skipped_directory, language_of_path

    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    relative = F.substring(plain, len(re.sub("^[a-z]+:/+", "/", root)) + 2, 1 << 20)
    kept = files.withColumn("relative", relative).where(extension(F.col("path")).isin([e.lstrip(".") for e in extensions]) & ~in_skipped_directory(F.col("relative")))
    if ignore:
        kept = kept.where(~ignored(F.col("relative"), ignore))
    if os.path.isdir(root):
        outside = links_outside(root)
        if outside:
            kept = kept.where(~F.col("relative").isin(outside) & ~F.exists(F.array(*map(F.lit, outside)), lambda o: F.col("relative").startswith(F.concat(o, F.lit("/")))))
    out = kept.select("path", "relative", F.decode("content", "UTF-8").alias("content"), language_of_path(F.col("path")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    return out.orderBy("path").limit(most) if most else out


def links_outside(root: str) -> list[str]:
    """Links below a local folder whose target lies outside it, as relative paths."""
    base = os.path.realpath(root)
    out = []
    for at, folders, names in os.walk(root):
        for name in [*folders, *names]:
            path = os.path.join(at, name)
            if os.path.islink(path) and not (os.path.realpath(path) + "/").startswith(base + "/"):
                out.append(os.path.relpath(path, root))
    return sorted(out)
