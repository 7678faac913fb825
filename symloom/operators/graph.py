"""Traversal and analysis of the symbol graph.

Edges are (src, dst) pairs with optional columns. Traversals that ask for nodes
go level by level: the frontier joins the edges, what was seen before is taken
out by an anti-join, and each level is cut into a table, so neither plans nor
data grow with the depth. Only traversals that ask for paths enumerate them, and
these are bounded by a depth.

Defined cases: edges with a null end are left out; self-edges never extend a
path; repeated edges count once; an empty seed or edge table gives no rows.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from symloom.session import as_table, cut, cut_counting

#: Depths of the transitive operators: default and most.
DEPTH, MAX_DEPTH = 10, 20
#: Levels of a traversal after which what was seen is written as one table.
MERGE = 8


def edges(dependencies: DataFrame, *types: str, reverse: bool = False) -> DataFrame:
    """Distinct edges of some types, from caller to callee or the other way round."""
    df = dependencies.where("from_symbol_id is not null and to_symbol_id is not null and from_symbol_id <> to_symbol_id")
    if types:
        df = df.where(F.col("dependency_type").isin(*types))
    a, b = ("to_symbol_id", "from_symbol_id") if reverse else ("from_symbol_id", "to_symbol_id")
    return df.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


def reach(links: DataFrame, seeds: DataFrame, depth: int | None = DEPTH, reverse: bool = False) -> DataFrame:
    """Nodes reached from seeds (seed) within a depth, of any depth when None: seed, node, depth (the least).

    Links and seeds become tables once, so no level computes them anew; a level
    reads the links and what was seen, nothing else. reverse goes against them.
    """
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    rounds = itertools.count(1) if depth is None else range(1, max(1, min(depth, MAX_DEPTH)) + 1)
    seed = F.col("seed").cast("long")
    seen, found = cut_counting(seeds.where("seed is not null").select(seed.alias("seed"), seed.alias("node"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    links = as_table(links)
    for d in rounds:
        if not found:
            break
        step = (
            frontier.select("seed", "node").join(links, F.col("node") == F.col(src)).select("seed", F.col(dst).alias("node")).distinct()
        )
        new, found = cut_counting(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(new)
        if d % MERGE == 0:
            seen = cut(seen)
        frontier = new
    return seen.where("depth > 0")


def paths(links: DataFrame, seeds: DataFrame, depth: int, end: Column | None = None, reverse: bool = False) -> DataFrame:
    """All simple paths from seeds up to a depth: seed, node, depth, path (from the seed on); reverse goes against the links.

    end, a condition on node, keeps the paths that stop there; a path that met
    it is not carried on.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    links = as_table(links)
    current = seeds.select(F.col("seed").cast("long")).distinct().select("seed", F.col("seed").alias("node"), F.array("seed").alias("path"))
    out: DataFrame | None = None
    for d in range(1, depth + 1):
        step, count = cut_counting(
            current.join(links, (F.col("node") == F.col(src)) & ~F.array_contains("path", F.col(dst))).select(
                "seed", F.col(dst).alias("node"), F.concat("path", F.array(dst)).alias("path")
            )
        )
        found = step.where(end) if end is not None else step
        found = found.select("seed", "node", F.lit(d).alias("depth"), "path")
        out = found if out is None else out.unionByName(found)
        current = step.where(~end) if end is not None else step
        if not count:
            break
    return out


def shortest_path(links: DataFrame, start: int, goal: int, depth: int | None = None) -> DataFrame:
    """One shortest path over edges taken as undirected: node ids in order, smallest ids preferred.

    Every node met carries the smallest of its shortest paths, so the last level
    holds the answer; levels go on until the goal is met, there are no new nodes
    or, where one is given, the depth is reached.
    """
    spark = links.sparkSession
    both = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    layer = spark.createDataFrame([(start, [start])], "node long, path array<long>")
    seen = layer.select("node")
    met, left = start == goal, 1
    for d in itertools.count(1):
        if met or not left or (depth is not None and d > depth):
            break
        step = layer.join(both, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        fresh = step.join(seen, "node", "left_anti").select("node", F.concat("path", F.array("node")).alias("path"))
        counts = Observation()
        layer = cut(fresh.observe(counts, F.count(F.lit(1)).alias("n"), F.count_if(F.col("node") == goal).alias("goal")))
        left, met = int(counts.get["n"] or 0), bool(counts.get["goal"])
        seen = seen.unionByName(layer.select("node"))
        if d % MERGE == 0:
            seen = cut(seen)
    if not met:
        return spark.createDataFrame([], "position int, node long")
    return layer.where(F.col("node") == goal).select(F.posexplode("path").alias("position", "node"))


def on_cycles(links: DataFrame) -> DataFrame:
    """Edges on a cycle, those within one strongly connected component: src, dst.

    Round by round, what nothing enters or nothing leaves is trimmed; each node
    takes the greatest id from which it is reached as its colour, and a
    component are the nodes of a colour from which that id is reached in turn.
    Components found are taken out, and the rest is coloured anew.
    """
    left, count = _trimmed(*cut_counting(links.select("src", "dst")))
    parts: list[DataFrame] = []
    while count:
        colour = _greatest_before(left)
        a, b = colour.toDF("a", "colour"), colour.toDF("b", "other")
        same = cut(
            left.join(a, F.col("src") == F.col("a")).join(b, F.col("dst") == F.col("b")).where("colour = other").select("src", "dst", "colour")
        )
        back = _greatest_before(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        a, b = back.toDF("a", "a_back"), back.toDF("b", "b_back")
        known = cut(
            same.join(a, F.col("src") == F.col("a"))
            .join(b, F.col("dst") == F.col("b"))
            .select("src", "dst", (F.col("a_back") == F.col("colour")).alias("src_in"), (F.col("b_back") == F.col("colour")).alias("dst_in"))
        )
        parts.append(known.where("src_in and dst_in").select("src", "dst"))
        left, count = _trimmed(*cut_counting(known.where("not src_in and not dst_in").select("src", "dst")))
    # nothing is left by now
    return reduce(DataFrame.unionByName, parts, left)


def _trimmed(left: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Edges that are left when all without an edge before or after them are taken out, and their number."""
    while count:
        into = left.select(F.col("dst").alias("n")).distinct()
        out_of = left.select(F.col("src").alias("n")).distinct()
        kept, now = cut_counting(
            left.join(into, F.col("src") == F.col("n"), "left_semi").join(out_of, F.col("dst") == F.col("n"), "left_semi")
        )
        if now == count:
            break
        left, count = kept, now
    return left, count


def _greatest_before(links: DataFrame) -> DataFrame:
    """Of every node the greatest id from which it is reached, itself included: node, best.

    In each round a node takes the greatest of its predecessors, and what that one has found.
    """
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    best = cut(nodes.withColumn("best", F.col("node")))
    while True:
        pulled = links.join(best, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "best", F.lit(None).cast("long").alias("old"))
        step = best.withColumn("old", F.col("best")).unionByName(pulled).groupBy("node").agg(F.max("best").alias("near"), F.max("old").alias("old"))
        far = best.toDF("f", "far")
        new, changed = cut_counting(
            step.join(far, F.col("near") == F.col("f")).select("node", F.greatest("near", "far").alias("best"), "old"), "best > old"
        )
        best = new.select("node", "best")
        if not changed:
            return best


def degrees(links: DataFrame) -> DataFrame:
    """In- and out-degree of every node, in one pass over the edges."""
    ends = links.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        links.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
