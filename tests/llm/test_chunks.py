import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.llm import chunks

SCHEMA = "item_id long, text string, language string, limit long, overlap long, piece string"


def pieces(text, limit, overlap, language=""):
    offsets, at, lines, levels = chunks.boundaries(text, language, limit)
    start, next_, first = chunks.successors(at, lines, levels, limit, overlap)
    ends = np.flatnonzero(chunks.reachable(next_, np.array([first]))).tolist()
    # the same cuts, one after the other
    walk, x = [first], first
    while x < len(offsets) - 1:
        x = int(next_[x])
        walk.append(x)
    assert ends == walk
    return [(int(offsets[a]), int(offsets[b])) for a, b in zip([0, *start[ends[:-1]].tolist()], ends, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab{}();, \né\U0001f600", min_size=1, max_size=300), st.integers(4, 60), st.integers(0, 6))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    cuts = pieces(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for a, b in cuts:
        assert len(text[a:b].encode()) <= limit
    for (a, b), (c, d) in zip(cuts, cuts[1:], strict=False):
        assert a < c <= b < d


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab}; é", max_size=14), min_size=1, max_size=60), st.integers(40, 120), st.integers(0, 12))
def test_overlap_is_whole_wherever_it_fits(lines, limit, overlap):
    text = "\n".join(lines)
    at = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" if i + 1 < len(text)]
    cuts = pieces(text, limit, overlap)
    for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False):
        shared = text[c:b].count("\n")
        assert shared <= overlap and (c == b or c in at)
        if shared < overlap and c > 0:
            # one line more would leave no room for the next one
            before = max(x for x in at if x < c)
            after = min([x for x in at if x > b], default=len(text))
            assert len(text[before:after].encode()) > limit


def test_overlap_and_boundaries():
    text = "".join(f"line {i}\n" for i in range(100))
    cuts = pieces(text, 200, 3)
    for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False):
        assert text[c:b].count("\n") == 3
    code = "".join(f"function f{i}() {{\n  a();\n  b();\n}}\n" for i in range(30))
    for _, b in pieces(code, 150, 0, "javascript"):
        assert code[:b].endswith("}\n")
    # of a piece of 35 lines more than 25 are shared where they and one more line fit
    text = "".join(f"row {i:03d} of it\n" for i in range(200))
    for (_, b), (c, d) in zip(pieces(text, 35 * 14, 100), pieces(text, 35 * 14, 100)[1:], strict=False):
        assert text[c:b].count("\n") == 34 and text[c:d].count("\n") == 35


def test_operator(spark):
    rng = random.Random(1)
    long = "x" * 5000
    rows = [
        (1, "short", None, 100, None, "n"), (2, long, None, 64, 2, "n"), (3, None, None, 10, 1, "n"), (4, "", None, 10, 1, "n"), (5, "é" * 50, "php", 1, -3, "n"),
        (None, "a\n" * 50, None, None, 1, "n"), (1, "short", None, 100, None, "n"), (7, "".join(rng.choice("a\n") for _ in range(3000)), None, 100, 100, "n"),
    ]
    got = chunks.split_items(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.item_id, []).append(r)
    assert len(by[1]) == 2 and 3 not in by and by[4][0].text == ""
    assert "".join(r.text for r in sorted(by[2], key=lambda r: r.piece)) == long
    assert all(r.bytes <= 64 for r in by[2]) and all(r.bytes <= 4 for r in by[5])
    assert chunks.split_items(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("overlap", [0, 100])
def test_options_in_force(spark, overlap):
    from symloom.sources.tables import current_options

    policy = "file_size_policy struct<chunking_threshold: bigint>"
    o = spark.createDataFrame([(1, 5, (10,), None, None, None), (2, 5, (20,), overlap, None, None)], f"id long, repo_id long, {policy}, chunk_overlap_lines int, include_node_modules boolean, created_at timestamp_ntz")
    s = spark.createDataFrame([(1, 5, "a.js", None, "x" * 15), (2, 6, "b.js", None, "y")], "file_id long, repo_id long, path string, language string, content string")
    got = chunks.source_items(s, current_options(o)).collect()
    assert [(r.item_id, r.limit, r.overlap) for r in got] == [(1, 20, overlap)]
