"""Parent-child links to full hierarchies, on pointer graphs cut by splitters.

Every node points to its parent. A hash of the id makes about one node in
``SPACING`` a splitter. First every node walks up to the next splitter or root,
by doubling its pointer over nodes that are no splitters; then the splitters
alone, a graph smaller by that factor, are solved the same way; last, each node
takes depth and root from the splitter it reached. Walking is a join per round,
and only nodes still under way take part, so the data moved falls quickly.

A walk that reaches no terminal ends on a circle. The number of nodes under way
after r rounds is the number further than 2^r from a terminal; distances have no
gaps, so a round that finishes none leaves only circles and what hangs below
them. Their smallest id is the minimum over a walk longer than the circle.

Defined cases: null ids are left out; of repeated ids one row counts, the one
with the greatest parent; a null parent or one that is no node makes a root; a
node that is its own parent is a circle of one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.session import cut, cut_counting

SPACING = 8
#: Longest parent chain that is walked before the input is refused (2**ROUNDS nodes).
ROUNDS = 40


def is_splitter(column: Column, spacing: int = SPACING) -> Column:
    """Deterministic choice of splitters by a hash of the id."""
    return F.pmod(F.xxhash64(column), F.lit(spacing)) == 0


def _targets(state: DataFrame, stop: Column, carry: bool) -> DataFrame:
    """What a pointer finds: a terminal stays where it is and adds nothing."""
    end = stop | F.col("terminal")
    return state.select(
        F.col("id").alias("t_id"),
        F.when(end, F.col("id")).otherwise(F.col("ptr")).alias("t_ptr"),
        F.when(end, F.lit(0).cast("long")).otherwise(F.col("dist")).alias("t_dist"),
        F.when(~end, F.col("low")).alias("t_low"),
        (end | F.col("done")).alias("t_done"),
        *([F.when(end, F.slice("path", 1, 0)).otherwise(F.col("path")).alias("t_path")] if carry else []),
    )


def _walk(state: DataFrame, left: int, stop: Column, carry: bool) -> tuple[DataFrame, DataFrame | None]:
    """Double pointers until each reaches a terminal.

    state: id, ptr, dist, low, terminal, done and, when carried, path; stop
    tells, on the column id, which nodes end a walk besides the terminals; left
    is the number of nodes that are not done. Returns the nodes that arrived and those that never will (id, circle), or
    None where there are none of these.
    """
    active = state.where("not done")
    finished = [state.where("done")]
    rounds = 0
    while left:
        target = _targets(_all([*finished, active]), stop, carry)
        joined, count = cut_counting(
            active.join(target, F.col("ptr") == F.col("t_id")).select(
                "id",
                F.col("t_ptr").alias("ptr"),
                (F.col("dist") + F.col("t_dist")).alias("dist"),
                F.least("low", "t_low").alias("low"),
                "terminal",
                F.col("t_done").alias("done"),
                *([F.concat("path", "t_path").alias("path")] if carry else []),
            ),
            "not done",
        )
        rounds += 1
        active = joined.where("not done")
        if count == left:
            return _all(finished), _circles(active, count, 2**rounds)
        finished.append(joined.where("done"))
        left = count
        if rounds > ROUNDS:
            raise RuntimeError(f"parent chains are longer than 2**{ROUNDS}")
    return _all(finished), None


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _circles(walkers: DataFrame, count: int, reach: int) -> DataFrame:
    """Smallest id of the circle that each walker ends on: columns id, circle.

    Walkers have gone reach steps so far. After a walk longer than their number a
    pointer lies on the circle and the minimum over the pointer's own walk is
    that of the circle.
    """
    state = walkers.select("id", "ptr", "low")
    while reach < 2 * count:
        t = state.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"), F.col("low").alias("t_low"))
        state = cut(
            state.join(t, F.col("ptr") == F.col("t_id")).select(
                "id", F.col("t_ptr").alias("ptr"), F.least("low", "t_low").alias("low")
            )
        )
        reach *= 2
    t = state.select(F.col("id").alias("t_id"), F.col("low").alias("circle"))
    return cut(state.join(t, F.col("ptr") == F.col("t_id")).select("id", "circle"))


def hierarchy(
    links: DataFrame, id_col: str, parent_col: str, name_col: str | None = None, spacing: int = SPACING
) -> DataFrame:
    """Root and depth of every node, with its path when names are given.

    Returns node_id, root_id, depth, is_cyclic, and with name_col path_ids and
    path_names from the root down. Of a node on or below a circle root_id is
    the smallest id on the circle and depth and paths are null.
    """
    carry = name_col is not None
    nodes = (
        links.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(parent_col).cast("long").alias("parent"),
            *([F.col(name_col).alias("name")] if carry else []),
        )
        .where("id is not null")
        .groupBy("id")
        .agg(F.max(F.struct("parent", *(["name"] if carry else []))).alias("row"))
        .select("id", "row.parent", *(["row.name"] if carry else []))
    )
    known = nodes.select(F.col("id").alias("k_id"))
    root = F.col("k_id").isNull()
    own = F.array(F.struct("id", "name")) if carry else None
    base, left = cut_counting(
        nodes.join(known, F.col("parent") == F.col("k_id"), "left").select(
            "id",
            F.coalesce("k_id", "id").alias("ptr"),
            F.when(root, 0).otherwise(1).cast("long").alias("dist"),
            F.col("id").alias("low"),
            root.alias("terminal"),
            root.alias("done"),
            *([F.when(root, F.slice(own, 1, 0)).otherwise(own).alias("path"), F.col("name")] if carry else []),
        ),
        "not done",
    )
    stop = is_splitter(F.col("id"), spacing)
    reached, lost = _walk(base.drop("name"), left, stop, carry)

    reduced = reached.where(stop | F.col("terminal")).withColumn("done", F.col("terminal"))
    if lost is not None:
        # a splitter below a circle without splitters ends the walks of those below it
        ends_lost = lost.where(stop)
        reduced = reduced.unionByName(
            ends_lost.select(
                "id",
                F.col("id").alias("ptr"),
                F.lit(0).cast("long").alias("dist"),
                F.col("id").alias("low"),
                F.lit(True).alias("terminal"),
                F.lit(True).alias("done"),
                *([F.expr("cast(array() as array<struct<id:bigint,name:string>>)").alias("path")] if carry else []),
            )
        )
    reduced, left = cut_counting(reduced, "not done")
    solved, turning = _walk(reduced, left, F.lit(False), carry)
    ends = solved.select(
        F.col("id").alias("s_id"),
        F.col("ptr").alias("s_root"),
        F.col("dist").alias("s_dist"),
        *([F.col("path").alias("s_path")] if carry else []),
    )
    if lost is not None:
        below = ends_lost.select(F.col("id").alias("l_id"), "circle")
        ends = ends.join(below, F.col("s_root") == F.col("l_id"), "left").drop("l_id")
    else:
        ends = ends.withColumn("circle", F.lit(None).cast("long"))
    if turning is not None:
        ends = ends.unionByName(turning.select(F.col("id").alias("s_id"), "circle"), allowMissingColumns=True)
    acyclic = F.col("circle").isNull()
    out = reached.join(ends, F.col("ptr") == F.col("s_id")).select(
        F.col("id").alias("node_id"),
        F.coalesce("circle", "s_root").alias("root_id"),
        F.when(acyclic, F.col("dist") + F.col("s_dist")).cast("int").alias("depth"),
        (~acyclic).alias("is_cyclic"),
        *([F.when(acyclic, F.concat("path", "s_path")).alias("path")] if carry else []),
    )
    if lost is not None:
        out = out.unionByName(
            lost.select(
                F.col("id").alias("node_id"),
                F.col("circle").alias("root_id"),
                F.lit(None).cast("int").alias("depth"),
                F.lit(True).alias("is_cyclic"),
            ),
            allowMissingColumns=True,
        )
    if not carry:
        return out
    names = base.where("terminal").select(F.col("id").alias("n_id"), "name")
    out = out.join(names, (F.col("root_id") == F.col("n_id")) & ~F.col("is_cyclic"), "left")
    top = F.array(F.struct(F.col("root_id").alias("id"), "name"))
    path = F.when(~F.col("is_cyclic"), F.reverse(F.concat("path", top)))
    return out.select("node_id", "root_id", "depth", "is_cyclic", path.alias("path")).select(
        "node_id",
        "root_id",
        "depth",
        "is_cyclic",
        F.col("path.id").alias("path_ids"),
        F.col("path.name").alias("path_names"),
    )


def circle_members(links: DataFrame, tree: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Nodes whose chain never ends: id, parent, circle (its smallest id) and whether the node lies on it.

    A pointer that has been doubled past the number of these nodes lies on the
    circle, and every node of a circle is where one of its own nodes ends up.
    """
    lost = cut(tree.where("is_cyclic").select(F.col("node_id").alias("id"), F.col("root_id").alias("circle")))
    parents = (
        links.select(F.col(id_col).cast("long").alias("p_id"), F.col(parent_col).cast("long").alias("parent")).where("p_id is not null").groupBy("p_id").agg(F.max("parent").alias("parent"))
    )
    nodes, count = cut_counting(lost.join(parents, F.col("id") == F.col("p_id")).select("id", "parent", "circle"))
    state, reach = nodes.select("id", F.col("parent").alias("ptr")), 1
    while reach < count:
        t = state.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"))
        state = cut(state.join(t, F.col("ptr") == F.col("t_id")).select("id", F.col("t_ptr").alias("ptr")))
        reach *= 2
    turning = state.select(F.col("ptr").alias("c_id")).distinct()
    return cut(
        nodes.join(turning, F.col("id") == F.col("c_id"), "left").select("id", "parent", "circle", F.col("c_id").isNotNull().alias("on_circle"))
    )


def descendants(paths: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Every pair of a node and one below it with their distance, from the paths of hierarchy().

    members, from circle_members(), adds the nodes below circles: each with all
    that lie above it up to the node of the circle that it hangs from. All nodes
    of a circle are above each other and above whatever hangs from it; they are
    not paired one by one, circle_members() names them.
    """
    if members is not None:
        hanging = members.select("id", F.when(~F.col("on_circle"), F.col("parent")).alias("parent"), F.lit(None).cast("string").alias("name"))
        paths = paths.where("not is_cyclic").unionByName(hierarchy(hanging, "id", "parent", "name"))
    return (
        paths.where("not is_cyclic and depth > 0")
        .select("node_id", "depth", F.posexplode(F.slice("path_ids", 1, F.size("path_ids") - 1)).alias("at", "ancestor_id"))
        .select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )
