"""Documents into containers of fixed capacity, by dominance and best fit.

Sizes are whole numbers of tokens up to the capacity, so the instance is no more
than a count per size, however many documents there are. The driver solves that
table: first Martello and Toth's reduction fixes containers that provably
dominate all others with the same largest document, many equal ones at a time;
what is left is packed by best fit in decreasing order, again by counts. The
solution says of each size which ranks go to which containers; ranks are counted
within (size, slice) and shifted by the counts of the slices before, so that a
size a third of all documents share is not one task's work. Only sizes of more
than ``RANKED_PER_TASK`` documents are sliced, and the shifts are a table that
stays in the cluster.

Defined cases: a document above the capacity is split into full containers and
a rest, which is packed like a document; a null or empty text takes no room and
goes to container 0; repeated doc_ids are separate documents; an empty table
gives no rows; a null or non-positive capacity gives no containers.
"""

from __future__ import annotations

import base64
import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.session import cut, spread

#: Vocabulary of the tokenizer that sizes are counted with, and its splitting pattern's module.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of that vocabulary (a fixed value of the tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one size that one task ranks.
RANKED_PER_TASK = 200_000


@functools.cache
def tokenizer(vocabulary: bytes):
    """The tokenizer of the lines of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and its number of tokens; the vocabulary is read by the driver and sent to the tasks (about 1 MB)."""
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(sent.value).encode_ordinary
        for pdf in batches:
            sizes = [len(encode(t)) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tokens": np.array(sizes, np.int64)})

    base = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return spread(base, 2).mapInPandas(count, "doc_id long, tokens long")


Pattern = tuple[tuple[int, int], ...]


def reduce(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Containers that dominance fixes, as (pattern, how many); takes them from counts.

    With j the largest document and r the room it leaves, {j} is fixed if nothing
    fits into r; {j, k}, with k the largest that fits, if k fills r, or if no two
    others fit into r, or if no three do and no two that fit exceed k. In each
    case whatever stands beside j in another packing fits in the place of k, so
    the exchange costs no container.
    """
    fixed: list[tuple[Pattern, int]] = []
    j = capacity
    while True:
        while j > 0 and not counts[j]:
            j -= 1
        if j <= 0:
            return fixed
        # larger documents come first; one that cannot be fixed is passed over
        size = j
        while size > 0:
            if not counts[size]:
                size -= 1
                continue
            done = _fix(counts, capacity, size)
            if done is None:
                size -= 1
            else:
                fixed.append(done)
        return fixed


def _smallest(counts: np.ndarray, n: int, without: int) -> int:
    """Sum of the n smallest documents besides one of the given size; very large if there are fewer."""
    total = 0
    for s in np.flatnonzero(counts):
        have = int(counts[s]) - (s == without)
        take = min(n, have)
        total += take * int(s)
        n -= take
        if not n:
            return total
    return 1 << 60


def _fix(counts: np.ndarray, capacity: int, j: int) -> tuple[Pattern, int] | None:
    room = capacity - j
    counts[j] -= 1
    fitting = np.flatnonzero(counts[: room + 1])
    counts[j] += 1
    if not len(fitting):
        n = int(counts[j]) if 2 * j > capacity else 1
        counts[j] -= n
        return ((j, 1),), n
    k = int(fitting[-1])
    sure = k == room or _smallest(counts, 2, j) > room
    if not sure and _smallest(counts, 3, j) > room:
        sure = k >= _best_pair(counts, room, j)
    if not sure:
        return None
    if k == j:
        n = int(counts[j]) // 2
        counts[j] -= 2 * n
        return ((j, 2),), n
    n = int(min(counts[j], counts[k])) if k == room or _smallest(counts, 2, j) > room else 1
    counts[j] -= n
    counts[k] -= n
    return ((j, 1), (k, 1)), n


def _best_pair(counts: np.ndarray, room: int, without: int) -> int:
    sizes = np.flatnonzero(counts[: room + 1])
    best = 0
    for a in sizes:
        rest = room - a
        others = sizes[(sizes <= min(rest, a))]
        for b in others[::-1]:
            need = 2 if a == b else 1
            if counts[a] - (a == without) >= need and counts[b] - (b == without) >= 1:
                best = max(best, int(a + b))
                break
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in decreasing order over counts; equal containers are kept as one entry."""
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(room: int, pattern: dict[int, int], n: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append([pattern, n])

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                full, rest = divmod(left, per)
                if full:
                    put(capacity - per * size, {size: per}, full)
                if rest:
                    put(capacity - rest * size, {size: rest}, 1)
                break
            room = rooms[i]
            group = open_[room]
            pattern, n = group.pop()
            if not group:
                rooms.pop(i)
                del open_[room]
            per = room // size
            use = min(n, left // per)
            if use:
                put(room - per * size, pattern | {size: pattern.get(size, 0) + per}, use)
                left -= use * per
                n -= use
            if n and 0 < left < per:
                put(room - left * size, pattern | {size: pattern.get(size, 0) + left}, 1)
                left = 0
                n -= 1
            if n:
                put(room, pattern, n)
    counts[:] = 0
    return [(tuple(sorted(p.items(), reverse=True)), n) for group in open_.values() for p, n in group]


def solve(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, int]], int]:
    """All containers as (pattern, how many), those fixed by dominance first, and how many these are."""
    counts = counts.astype(np.int64).copy()
    fixed = reduce(counts, capacity)
    return fixed + best_fit(counts, capacity), sum(n for _, n in fixed)


def bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of containers that any packing needs (Martello and Toth's L2).

    For each k, documents above capacity - k stand alone, those above half stand
    apart from each other, and what is left of the rest from size k on must find
    room beside the latter.
    """
    sizes = np.arange(capacity + 1)
    n = np.concatenate([[0], counts.astype(np.int64).cumsum()])
    total = np.concatenate([[0], (counts * sizes).astype(np.int64).cumsum()])
    half = capacity // 2
    k = np.arange(half + 1)
    alone = n[-1] - n[capacity - k + 1]
    apart = n[capacity - k + 1] - n[half + 1]
    room = apart * capacity - (total[capacity - k + 1] - total[half + 1])
    rest = total[half + 1] - total[k]
    return int((alone + apart + np.maximum(0, -((room - rest) // capacity))).max())


def _ranges(solution: list[tuple[Pattern, int]], capacity: int, first: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each size the rank at which a range starts, its first container and documents per container."""
    starts: dict[int, list] = {}
    used = np.zeros(capacity + 1, np.int64)
    container = first
    for pattern, n in solution:
        for size, k in pattern:
            starts.setdefault(size, []).append((int(used[size]), container, k))
            used[size] += k * n
        container += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in starts.items()}


def pack(counts: DataFrame, limit_id: int, capacity: int) -> tuple[DataFrame, dict]:
    """Container of every piece: limit_id, doc_id, piece, start_token, end_token, container.

    counts: doc_id, tokens, as a table that may be read more than once.
    """
    spark: SparkSession = counts.sparkSession
    full = F.floor(F.col("tokens") / capacity)
    rest = F.col("tokens") % capacity
    pieces = full + F.when((rest > 0) | (full == 0), 1).otherwise(0)
    parts = counts.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * F.lit(capacity).cast("long")).alias("start_token"),
        F.least((F.col("piece") + 1) * F.lit(capacity).cast("long"), "tokens").alias("end_token"),
    )
    sized = parts.withColumn("size", (F.col("end_token") - F.col("start_token")).cast("int"))
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if size:
            table[size] = n
    solution, fixed = solve(table, capacity)
    containers = sum(n for _, n in solution)
    hot = [(size, -(-n // RANKED_PER_TASK)) for size, n in histogram.items() if n > RANKED_PER_TASK]
    slice_ = F.lit(0)
    if hot:
        # at most one entry per size, so the capacity bounds it
        per_size = F.create_map(*[F.lit(x) for pair in hot for x in pair])
        slice_ = F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(F.try_element_at(per_size, F.col("size")), F.lit(1)))
    sliced = sized.withColumn("slice", slice_.cast("int"))
    if hot:
        sums = Window.partitionBy("b_size").orderBy("b_slice").rowsBetween(Window.unboundedPreceding, -1)
        before = (
            sliced.where(F.col("size").isin([s for s, _ in hot]))
            .groupBy(F.col("size").alias("b_size"), F.col("slice").alias("b_slice"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("b_size", "b_slice", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("shift"))
        )
        sliced = sliced.join(before, (F.col("size") == F.col("b_size")) & (F.col("slice") == F.col("b_slice")), "left").drop("b_size", "b_slice")
    else:
        sliced = sliced.withColumn("shift", F.lit(0))
    sliced = sliced.withColumn("shift", F.coalesce("shift", F.lit(0)).cast("long"))
    sent = spark.sparkContext.broadcast(_ranges(solution, capacity, 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = sent.value
        seen: dict[tuple[int, int], int] = {}
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            sizes, slices, shift = pdf["size"].to_numpy(), pdf["slice"].to_numpy(), pdf["shift"].to_numpy()
            for key, rows in pd.DataFrame({"a": sizes, "b": slices}).groupby(["a", "b"]).indices.items():
                key = (int(key[0]), int(key[1]))
                if not key[0]:
                    continue
                start = seen.get(key, 0)
                seen[key] = start + len(rows)
                rank = shift[rows] + start + np.arange(len(rows))
                starts, first, per = ranges[key[0]]
                i = np.searchsorted(starts, rank, side="right") - 1
                out[rows] = first[i] + (rank - starts[i]) // per[i]
            yield pdf[["doc_id", "piece", "start_token", "end_token"]].assign(container=out, limit_id=limit_id)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = (
        sliced.repartition(tasks, "size", "slice")
        .sortWithinPartitions("size", "slice", "doc_id", "piece")
        .mapInPandas(place, "doc_id long, piece int, start_token long, end_token long, container long, limit_id long")
        .select("limit_id", "doc_id", "piece", "start_token", "end_token", "container")
    )
    tokens = int((table * np.arange(capacity + 1)).sum())
    facts = {
        "limit_id": limit_id,
        "capacity_tokens": capacity,
        "pieces": int(sum(histogram.values())),
        "containers": containers,
        "fixed_by_dominance": fixed,
        "least_possible": bound(table, capacity),
        "fill": round(tokens / (containers * capacity), 6) if containers else 0.0,
    }
    return placed, facts


def pack_all(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[dict]]:
    """pack() for every limit; texts are counted once."""
    counts = cut(token_counts(documents, vocabulary))
    out, facts = None, []
    for r in limits.where("capacity_tokens > 0").orderBy("limit_id").collect():
        placed, f = pack(counts, r["limit_id"], r["capacity_tokens"])
        out = placed if out is None else out.unionByName(placed)
        facts.append(f)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "limit_id long, doc_id long, piece int, start_token long, end_token long, container long")
    return out, facts
