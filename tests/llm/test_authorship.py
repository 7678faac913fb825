import random

import numpy as np

from symloom.llm import authorship as A
from symloom.llm.forest import Forest


def test_forest_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -0.5)).astype(float)
    forest = Forest.fit(x[:2000], y[:2000])
    assert ((forest.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85
    assert forest.predict(np.zeros((0, 6))).shape == (0,)


def test_notices_are_labels_and_not_features():
    notice = "// Code generated by x; DO NOT EDIT.\n"
    code = "export const a = 1;\nfunction b() { return a; }\n"
    assert A.label(notice + code) == 1 and A.label("/*! lib v1.2.3 | MIT License | (c) Lib Authors */\n" + code) == 1
    assert A.label("// Written by hand since the generator was retired.\n" + code) == 0
    assert A.label("// Copyright (c) 2024 Some Company\n" + code) == -1
    assert A.label('// Builds the "@generated" banner that other files carry.\n' + code) == -1 and A.label(code) == -1
    assert A.measure(notice + code) == A.measure(code)
    assert A.windows(notice + code) == A.windows(code)


def test_windows_survive_changed_lines_and_remarks():
    lines = [f"const value{i} = compute(input{i}, {i}); register(value{i});" for i in range(40)]
    assert A.windows("<template><p/></template>\n<script>\n" + "\n".join(lines) + "\n</script>\n<style></style>") == A.windows("\n".join(lines))
    changed = lines[:10] + ["// ours: kept"] + lines[10:20] + ["debug();"] + lines[20:]
    old, new = set(A.windows("\n".join(lines))), set(A.windows("\n".join(changed)))
    assert len(old & new) >= 0.8 * len(old)


def test_data_is_told_from_code():
    table = "export default [\n" + ", ".join(map(str, range(200))) + "\n];\n"
    assert A.is_data(A.measure(table), table)
    code = "function f() { return [1, 2, 3].map((x) => x + 1); }\n"
    assert not A.is_data(A.measure(code), code)


def _hand(rng):
    name = lambda: rng.choice("load save merge".split()) + rng.choice("Order Track Badge".split()) + str(rng.randrange(99))
    return "".join(f"// explains why {name()} waits\nfunction {name()}(row, limit) {{\n  if (row.{name()} > limit) {{\n    return this.{name()}(row);\n  }}\n  return null;\n}}\n" for _ in range(rng.randrange(3, 8)))


def _made(rng):
    return "".join(f"  public const int Value{i} = {i};\n" for i in range(rng.randrange(30, 60)))


def test_operator(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(240):
        made = i % 3 == 0
        text = _made(rng) if made else _hand(rng)
        if i % 2:
            text = ("// <auto-generated />\n" if made else "// Copyright (c) 2024 Some Company, internal use only\n") + text
        rows.append((i, i % 7, f"src/f{i}.js", text, "n"))
        want[i] = made
    rows += [(900, 1, None, None, "n"), (901, None, "x.js", " \n", "n")]
    df = spark.createDataFrame(rows, "file_id long, repo_id long, path string, content string, label string")
    got = {r.file_id: r.is_foreign for r in A.classify(df).collect()}
    assert set(got) == set(want)
    assert np.mean([got[i] == want[i] for i in want]) > 0.97
    assert A.classify(df.where("false")).collect() == []
    # a copyright line or a tool's notice does not decide, the forest does
    own = [(950, 1, "c.js", "// Copyright (c) 2024 Some Company\n" + _hand(rng), "n"), (951, 1, "g.js", "// do not edit\n" + _hand(rng), "n")]
    more = A.classify(df.unionByName(spark.createDataFrame(own, df.schema))).where("file_id >= 950").collect()
    assert [r.is_foreign for r in more] == [False, False]
    right = {r.label: (r.right, r.files) for r in A.held_out(df).where("not data").collect()}
    assert all(a >= 0.97 * b for a, b in right.values()) and len(right) == 2
