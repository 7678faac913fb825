import datetime
import random

from symloom.operators import references as R

REFS = "field string, row_id long, key long, created_at timestamp_ntz"
DAY = datetime.datetime(2024, 5, 1)


def run(spark, parents, refs):
    p = spark.createDataFrame([(x,) for x in parents], "key long")
    r = spark.createDataFrame(refs, REFS)
    return sorted((x.field, x.row_id, x.key) for x in R.dangling(p, r).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "WIDTH", 50)
    monkeypatch.setattr(R, "ROWS_PER_TASK", 20)
    rng = random.Random(4)
    parents = [rng.randrange(-500, 3000) for _ in range(1500)]
    refs = [("a.x", i, 777 if i % 3 == 0 else rng.randrange(-600, 3200), DAY) for i in range(2000)]
    refs += [("a.x", 1, None, DAY), ("b.y", None, 5, DAY), ("b.y", 7, 0, None), ("b.y", 7, 0, None)]
    known = set(parents)
    want = sorted({(f, i, k) for f, i, k, _ in refs if k is not None and i is not None and k not in known})
    assert run(spark, parents, refs) == want


def test_sparse_keys_with_a_dense_place(spark, monkeypatch):
    monkeypatch.setattr(R, "WIDTH", 50)
    monkeypatch.setattr(R, "FULL", 400)
    rng = random.Random(6)
    parents = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + list(range(2**60, 2**60 + 3000, 2)) + [-(2**63), 2**63 - 1]
    asked = rng.sample(parents, 200) + [x + 1 for x in rng.sample(parents, 200) if x < 2**63 - 1] + [2**60 + i for i in range(200)]
    refs = [("a.x", i, k, DAY) for i, k in enumerate(asked)]
    known = set(parents)
    assert run(spark, parents, refs) == sorted({(f, i, k) for f, i, k, _ in refs if k not in known})
    held = R._ranges(spark.createDataFrame([(x,) for x in parents], "key long"), 50 * 2**50)(spark.createDataFrame([(x,) for x in parents], "key long")).groupBy("bucket").count()
    assert held.agg({"count": "max"}).first()[0] <= 400


def test_no_parents_and_no_references(spark):
    assert run(spark, [], [("t.c", 1, -1, DAY)]) == [("t.c", 1, -1)]
    assert run(spark, [1], []) == []


def test_months_and_deletions(spark):
    misses = spark.createDataFrame(
        [("t", "c", 1, 9, DAY), ("t", "c", 2, 9, DAY), ("t", "c", 3, 8, None)], "table_name string, field_name string, row_id long, target_id long, created_at timestamp_ntz"
    )
    assert sorted(tuple(r) for r in R.by_month(misses).collect() if r.month) == [("t", "c", "2024-05", 2, 1)]
    s = spark.createDataFrame([(1, DAY), (2, DAY)], "id long, updated_at timestamp_ntz")
    later = DAY + datetime.timedelta(days=1)
    d = spark.createDataFrame([(1, later), (2, DAY), (3, later), (None, later)], "symbol_id long, deleted_at timestamp_ntz")
    assert [r.id for r in R.gone_symbols(s, d).collect()] == [1]
