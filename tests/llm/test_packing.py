import itertools
import random

import numpy as np
import pytest

from symloom.llm import packing

SCHEMA = "doc_id long, tokens long"


def least(sizes, capacity):
    best = len(sizes)
    for order in set(itertools.permutations(sizes)):
        bins = [0]
        for s in order:
            if bins[-1] + s > capacity:
                bins.append(0)
            bins[-1] += s
        best = min(best, len(bins))
    return best


def check(solution, sizes, capacity):
    used = {}
    for pattern, n in solution:
        assert n > 0 and sum(s * k for s, k in pattern) <= capacity
        for s, k in pattern:
            used[s] = used.get(s, 0) + k * n
    want = {s: sizes.count(s) for s in set(sizes)}
    assert used == want


@pytest.mark.parametrize("seed", range(40))
def test_valid_and_near_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 17))
    sizes = [rng.randint(1, capacity) for _ in range(7)]
    solution, _ = packing.solve(np.bincount(sizes, minlength=capacity + 1), capacity)
    check(solution, sizes, capacity)
    best = least(sizes, capacity)
    assert packing.bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= best
    assert sum(n for _, n in solution) <= best + 1


@pytest.mark.parametrize("seed", range(40))
def test_dominance_costs_no_container(seed):
    rng = random.Random(100 + seed)
    capacity = 12
    sizes = [rng.randint(2, capacity) for _ in range(7)]
    counts = np.bincount(sizes, minlength=capacity + 1)
    fixed = packing.reduce(counts, capacity)
    rest = [s for s in range(capacity + 1) for _ in range(counts[s])]
    assert sum(n for _, n in fixed) + (least(rest, capacity) if rest else 0) == least(sizes, capacity)


def test_large_counts_are_quick_and_full():
    rng = np.random.default_rng(1)
    counts = np.zeros(2049, np.int64)
    counts[1:] = rng.integers(0, 3_000_000, 2048)
    solution, _ = packing.solve(counts, 2048)
    assert sum(n for _, n in solution) < 1.01 * packing.bound(counts, 2048)


def test_assignment(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_PER_TASK", 50)
    rng = random.Random(5)
    rows = [(i, 40 if i % 3 == 0 else rng.randrange(0, 330)) for i in range(900)] + [(5, 40)]
    placed, facts = packing.pack(spark.createDataFrame(rows, SCHEMA).cache(), 1, 100)
    got = placed.collect()
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.end_token - r.start_token
    assert max(load.values()) <= 100 and max(load) + 1 == facts["containers"] == len(load)
    assert sum(load.values()) == sum(t for _, t in rows)
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    whole = dict(rows)
    assert all(r.piece == 0 for r in got if r.doc_id != 5 and whole[r.doc_id] <= 100)


def test_texts_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    limits = spark.createDataFrame([(1, 4), (2, None), (3, 0)], "limit_id long, capacity_tokens int")
    placed, facts = packing.pack_all(d, limits)
    assert sorted((r.doc_id or 0, r.container) for r in placed.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0)] and facts[0]["containers"] == 1
    placed, facts = packing.pack_all(d.where("false"), limits)
    assert placed.collect() == [] and facts[0]["containers"] == 0
