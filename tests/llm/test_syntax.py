import pytest

from symloom.llm import sources
from symloom.llm.sources import syntax_errors

GOOD = {
    "javascript": [
        "", "#!/usr/bin/env node\nreturn 1", "const {a = 1, ...b} = c ?? d?.e?.[0];\nlabel: for (const x of y) { if (x) continue label; }",
        "class A extends B { #p = 1; static { this.x = 2; } get y() { return this.#p; } async *z() { yield* q; await w; } }",
        "const f = async ({ a, b: [c] }) => `x${a ? `y${b}` : ''}z`;\nexport default f;", "a = b / c / /re[/]x/g.test(d) ? 1 : 2", "({ a = 1 } = b); [c, d] = [d, c]",
        "x\n++y", "if (a) ; else b()", "import('x').then(y => z)", "for (var i = 0, n = 3; i < n; i++) {}", "let async; async = 1; var of, get, set, let2",
        "const s = 'a\\\nb'; // { ( [\n/* ` */",
    ],
    "typescript": [
        "export type A<T extends object = {}> = { readonly [K in keyof T]?: T[K] extends (infer U)[] ? U : never } | `a${string}`;",
        "abstract class C<T> implements I<T>, J { constructor(private readonly a: number, public b?: string) { super(); } abstract m(): void; get x(): number { return 1 } declare y: string; [k: string]: any }",
        "function f(this: Foo, a?: number, ...r: string[]): a is number;\nfunction f(a) { return a as unknown as number; }", "const m = new Map<string, Array<number>>();\nconst g = <T,>(x: T): T => x;\nlet v = f<number>(1)!.b satisfies C;",
        "@Dec({ a: 1 }) export class D { @In() p!: string; @Out() m(@P() q: Q): void {} }", "declare module 'x' { export const y: number; }\nnamespace N.M { export enum E { A = 1, B } }\nimport type { T } from './t';",
        "const a = b < c && d > (e); const h = (x: number): string => x ? (y) : z;", "const e = cond ? (a) : b; type F = new (...args: any[]) => object; let t: [a: string, b?: number, ...c: X[]];",
    ],
    "php": [
        "<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\D as E;\nfinal class F extends G implements H { use T; public const X = 1; public function __construct(private readonly ?int $a = null, protected A|B $b) {} abstract protected static function z(): static; }",
        "<?php enum S: string { case A = 'a'; public function l(): string { return match($this) { self::A, self::B => 'x', default => throw new E() }; } }",
        "<?php $f = fn (int ...$x) => [...$x, 'k' => $y?->z ?? static function () use (&$q): void {}]; [$a, [, $b]] = $c; echo <<<TXT\n a {$b->c['d']} {\n TXT;",
        "<p><?= $x ?></p>\n<?php if ($a): ?>b<?php elseif ($c): ?>d<?php endif; ?>", "<?php #[Attr(1)]\nfunction f() { yield from g(); return strlen(...); }\n$x = (int) '1' <=> 2; // {\n# {\n",
        "<?php foreach ($a as ['x' => $b]) { switch ($b) { case 1: break 2; default: } }\ntry { } catch (A | B) { } finally { }",
    ],
    "csharp": [
        "using System;\nusing X = A.B<int>;\nnamespace N;\n[Serializable] public sealed partial record class R<T>(int A, string? B = null) : Base(A), I where T : class, new() { public int P { get; init; } = 1; int this[int i] => i; public static R<T> operator +(R<T> a, R<T> b) => a; }",
        "class A { async Task<(int a, string b)> F<T>(T[] x, out int y, params object[] z) { var q = from a in x where a is { P: > 1 and < 5 } or null orderby a descending select new { a, B = 1 }; y = 1; return (1, $\"{q:N2} {{x}} {(a ? \"b\" : @\"c\")}\"); } }",
        "class B { event EventHandler E; ~B() { } public B() : base() { lock (this) { using var s = new S { A = 1, [2] = 3 }; } int Local(int a) => a switch { 1 => 2, _ when a > 3 => throw new X(), _ => default }; } }",
        "#region x\nint[] a = { 1, 2 };\nif (a is [1, .. var r]) Console.WriteLine(a[^1] >> 2);\n#endregion\n", "var s = \"\"\"\n { ( \"\n \"\"\"; List<List<int>> l = new(); object o = (object)l ?? (string)null!;",
        "interface I { int X { get; } void M(); }\nenum E : byte { A = 1, B, }\ndelegate T D<in T>(T t);", "goto end; end: ; for (int i = 0, j = 1; i < 3; i++, j--) { } do { } while (false);",
    ],
    "vue": [
        "<template><p v-if=\"a > 1\">{{ b }}<br></p></template>\n<script setup lang=\"ts\">\nconst a: number = 1;\n</script>\n<style scoped>a { }</style>", "<script>export default { data() { return {} } }</script>", "﻿<!-- x --><template><A/></template>", "<template><p>{{ a <b }}<template #x></template></template>",
    ],
}
BAD = {
    "javascript": ["const a;", "if (a {", "x = [1, 2", "function () {}", "a b", "return }", "`x${a`", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "interface A { b: number }", "for (;;", "({ a = 1 })", "1 = 2", "break;", "import x from 'y'; return 1", "/* x", "'a", "f(a, , b)"],
    "typescript": ["let x: = 1;", "class { }", "type A = ;", "enum { A }", "const f = (a: number => a;", "function f(a: ) {}"],
    "php": ["", "no code", "<?php if ($a {", "<?php class { }", "<?php $a = ;", "<?php function f( { }", "<?php echo 'a", "<?php foo(1,,2);", "<?php }", "<?php $x = <<<A\n b"],
    "csharp": ["class A {", "class A { void F( { } }", "x y z;", "class A { int = 1; }", "var s = \"a", "f(1, , 2);", "return (1;", "#endif", "class A { public public(); }"],
    "vue": ["", "plain text", "<template><p></template", "<style></style>", "<script>const a = ;</script>", "<template><p>", "<script>const a = 1;"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in GOOD.items() for t in v])
def test_accepts(language, text):
    assert syntax_errors(text, language) == []


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in BAD.items() for t in v])
def test_rejects(language, text):
    assert syntax_errors(text, language)


def test_recovers_and_keeps_all_errors():
    errors = syntax_errors("const a = ;\nconst ok = 1;\nlet b = [1, ;\nfunction f() {}\nif (c {}\n", "javascript")
    assert len(errors) >= 3 and [e[1] for e in errors] == sorted(e[1] for e in errors)


def test_deep_and_long_texts():
    assert syntax_errors("(" * 500 + "1" + ")" * 500, "javascript") == []
    assert syntax_errors("x = 1;\n" * 50_000, "javascript") == []
    assert syntax_errors("[" * 5000, "javascript")


@pytest.mark.parametrize("n", [2_500, 30_000])
def test_depth_has_no_limit(n):
    for language, start, x in (("javascript", "", "a"), ("typescript", "", "a"), ("php", "<?php ", "$a"), ("csharp", "", "a")):
        assert syntax_errors(f"{start}if ({x}) {{}} " + f"else if ({x}) {{}} " * n, language) == []
        assert syntax_errors(f"{start}{x} = " + "(" * n + "1" + ")" * n + ";", language) == []
        assert syntax_errors(f"{start}{x} = " + "(" * n + "1" + ")" * (n - 1) + ";", language)
        if language != "php":
            assert syntax_errors(f"{x} = " + f"{x} ? b : " * n + "c;", language) == []
            assert syntax_errors(f"{x} = " + f"{x} ? b : " * n + ";", language)


ELEMENTS = [
    "const a = <div className=\"x\" {...p} on={() => { f(<b/>) }}>hi {name} <B.C x='1'/> {/* c */}{list.map(i => <li key={i}>{i > 1 ? <a/> : null}</li>)}</div>;",
    "function A() { return (<><p>don't</p></>); }", "const x = a < b && c > d;", "export default () => <input disabled value={`a${b}`} />;",
]
NO_ELEMENTS = ["const a = <div>;", "const a = <div></span>;", "a = <b c=>x</b>", "a = <b>{1 2}</b>", "a = <b>}</b>", "a = <b {c></b>"]


def test_elements_where_the_name_of_the_file_allows_them():
    for text in ELEMENTS:
        assert syntax_errors(text, "javascript", "src/a.jsx") == [] and syntax_errors(text, "typescript", "src/a.tsx") == []
    for text in NO_ELEMENTS:
        assert syntax_errors(text, "javascript", "a.jsx")
    generic = "const f = <T,>(x: T): T => x; const g = <T extends object>(x: T) => <b>{x as any}</b>; let y = a as B<C>;"
    assert syntax_errors(generic, "typescript", "a.tsx") == []
    assert syntax_errors(ELEMENTS[0], "javascript", "a.js") and syntax_errors("let a = <T>b;", "typescript", "a.ts") == []


SCHEMA = "file_id long, repo_id long, path string, language string, content string, repo string"


def test_operator_and_rates(spark):
    rows = [
        (1, 1, "a.js", "javascript", "a(", "x"), (2, 1, "b.ts", None, "let x: number", "x"), (3, 1, "c.txt", "odd", "z", "x"),
        (4, None, None, "PHP ", None, None), (1, 1, "a.js", "javascript", "a(", "x"), (None, 2, "d.cs", "csharp", "class A {}", "x"),
    ]
    parsed = sources.parse_sources(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.file_id or 0, r.language, r.accepted) for r in parsed.collect())
    assert got == [(0, "csharp", True), (1, "javascript", False), (1, "javascript", False), (2, "typescript", True), (3, None, None), (4, "php", False)]
    rates = {(r.repo_id, r.language): (r.files, r.invalid, r.rate) for r in sources.failure_rates(parsed, "repo_id", "language").collect()}
    assert rates[1, "javascript"] == (2, 2, 1.0) and rates[2, "csharp"] == (1, 0, 0.0)
    errors = spark.createDataFrame([(1, ".\\A.js", "bad", None), (1, None, "x", None)], "repo_id long, file_path string, message string, created_at timestamp_ntz")
    assert {r.file_id: r.reports for r in sources.reported(parsed, errors).collect()} == {1: 1, 4: 0}
    assert sources.parse_sources(spark.createDataFrame([], SCHEMA)).collect() == []
