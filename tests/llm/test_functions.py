from symloom.llm import authorship, sources
from symloom.llm.syntax.functions import describes, functions, prose

LONG = "Keeps the rows that were seen more than once today."


def found(text, language):
    return [(f.name, f.start_line, bool(f.doc and describes(f.doc, f.name))) for f in functions(text, language)]


def test_script():
    text = f"""/**
 * {LONG}
 * @param {{string}} a the first
 */
@Memo({{ b: 1 }})
export async function first(a) {{ return `{{ function no() {{}} }}`; }}

// {LONG}

function apart() {{}}
class A {{
  // Keeps the rows that
  // were seen twice.
  static run() {{ if (x) {{ y(); }} }}
  /* {LONG} */ stuck() {{}}
  abstract none(): void;
}}
const value = (a) => a * 2;
const o = {{ m(x) {{}}, k: function () {{}} }};
"""
    assert found(text, "typescript") == [("first", 6, True), ("apart", 10, False), ("run", 14, True), ("stuck", 15, False), ("value", 18, False), ("m", 19, False)]


def test_php_csharp_vue():
    php = f"<?php\nclass A {{\n    # {LONG}\n    #[Route('/x')]\n    public static function go(int $a): ?array {{ return [function () {{}}]; }}\n    abstract function no();\n}}\n"
    assert found(php, "php") == [("go", 5, True)]
    cs = f"class A\n{{\n    /// <summary>{LONG}</summary>\n    /// <param name=\"x\">y</param>\n    [HttpGet(\"a/{{b}}\")]\n    public async Task<List<int>> Go<T>(int x) where T : class\n    {{\n        if (Other(x)) {{ }}\n        return new Foo(x) {{ A = 1 }};\n    }}\n    int One(int a) => a;\n    void No();\n    int P {{ get; }}\n}}\n"
    assert found(cs, "csharp") == [("Go", 6, True), ("One", 11, False)]
    vue = f"<template><p/></template>\r\n<script setup>\r\n// {LONG}\r\nfunction go() {{}}\r\n</script>\r\n"
    assert found(vue, "vue") == [("go", 4, True)]


def test_what_counts_as_description():
    assert describes(f"/** {LONG} */", "x") == LONG
    for doc, name in (
        ("/** */", "a"), ("// Group the cached audit of the function", "groupCachedAuditOf"), ("// Schedules the roster for the invoice.", "scheduleRosterForInvoice"),
        ("// TODO: write a proper description here", "x"), ("/** {@inheritdoc} */", "x"), ("// see the description of the parent method", "x"), ("// =====================", "x"),
        ("/**\n * @param {Map<string, string[]>} a b c d e f\n * @returns {*}\n */", "x"), ("/* eslint-disable no-console, no-undef, no-alert, max-len */", "x"), ("// only four words here", "x"),
        ("// if (a) { return call(b, c, d, e); }", "x"), ("/// <inheritdoc cref=\"A.B\"/>", "x"),
    ):
        assert describes(doc, name) == "", doc
    assert prose("/**\n * One line.\n *\n * ----------\n */") == "One line."


def test_operator(spark):
    rows = [(1, 1, "a.js", "javascript", f"// {LONG}\nfunction f() {{}}", "x"), (2, 1, "b.js", "javascript", None, "x"), (3, 1, "c.js", "javascript", f"// {LONG}\nfunction g() {{", "x")]
    df = spark.createDataFrame(rows, "file_id long, repo_id long, path string, language string, content string, name string")
    assert [(r.file_id, r.name, r.start_line, r.description) for r in sources.exploded(authorship.first_pass(df, sources.pairs, sources.PAIRS)).collect()] == [(1, "f", 2, LONG)]
