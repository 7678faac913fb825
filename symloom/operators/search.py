"""Lexical, full-text, vector and hybrid search over symbols.

Defined cases: an empty query gives no rows; null texts match nothing; ties are
ordered by name and id; vectors of another length than the query's are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.exprs import contains_ci

#: Weights of the parts of a hybrid search.
WEIGHTS = {"lexical": 0.3, "vector": 0.4, "fulltext": 0.3}

#: What a cover without other words adds to a rank (fixed value).
COVER = 0.1
#: Query vectors that are compared with all rows at once.
QUERY_BLOCK = 2_048
#: Symbol types that a search for an entity looks at (fixed values).
TYPES_OF_ENTITY = {
    "function": ("function",), "class": ("class",), "interface": ("interface",), "method": ("method",), "property": ("property",), "variable": ("variable",),
    "component": ("component",), "service": ("class",), "controller": ("class",), "model": ("class",), "store": ("function", "variable"), "composable": ("function",),
}


def tokens_of(query: str) -> list[str]:
    return query.split()


def lexical(symbols: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Score by how many of name, signature and description hold each word; exact and prefix names first."""
    words = tokens_of(query)
    if not words:
        return symbols.select("id", "name").withColumns({"score": F.lit(0), "boost": F.lit(0)}).where("false")
    score = sum(
        (F.when(contains_ci(F.col(c), w), 1).otherwise(0) for w in words for c in ("name", "signature", "description")), F.lit(0)
    )
    name, first = F.lower(F.coalesce("name", F.lit(""))), words[0].lower()
    boost = F.when(name == first, 1000).when(name.startswith(first), 100).when(F.contains(name, F.lit(first)), 10).otherwise(0)
    return (
        symbols.select("id", "name", score.alias("score"), boost.alias("boost"))
        .where("score > 0")
        .orderBy(F.desc("score"), F.desc("boost"), F.asc("name"), F.asc("id"))
        .limit(limit)
    )


def word_list(*columns: str) -> Column:
    """Lower-case words of some columns in their order, camel case taken apart."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    apart = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^a-z0-9]+"), lambda x: x != "")


def cover_density(words: Column, query: list[str]) -> Column:
    """Rank of a text by its covers: the shortest stretches that hold every word of the query.

    A cover adds COVER / (1 + its words that are none of the query's). Zero
    where a word is missing.
    """
    wanted = F.array(*map(F.lit, query))
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(wanted, w), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    starts = F.transform(places, lambda x: x["at"])

    def end(p: Column) -> Column:
        # the last of the first places of every word from p on, null where one does not come any more
        firsts = F.transform(wanted, lambda w: F.array_min(F.transform(F.filter(places, lambda x: (x["word"] == w) & (x["at"] >= p)), lambda x: x["at"])))
        return F.when(~F.exists(firsts, lambda x: x.isNull()), F.array_max(firsts))

    spans = F.filter(F.transform(starts, lambda p: F.struct(p.alias("a"), end(p).alias("b"))), lambda x: x["b"].isNotNull())
    shortest = F.filter(spans, lambda x: ~F.exists(spans, lambda y: (y["b"] == x["b"]) & (y["a"] > x["a"])))

    def noise(x: Column) -> Column:
        held = F.size(F.filter(starts, lambda s: (s >= x["a"]) & (s <= x["b"])))
        return x["b"] - x["a"] - (held - 1)

    return F.aggregate(shortest, F.lit(0.0), lambda total, x: total + F.lit(COVER) / (1 + noise(x)))


def fulltext(symbols: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Symbols that hold every word of the query, by the density of their covers; words are not stemmed."""
    words = list(dict.fromkeys(w for w in re.split(r"[^a-z0-9]+", query.lower()) if w))
    if not words:
        return symbols.select("id", "name").withColumn("rank", F.lit(0.0)).where("false")
    held = symbols.select("id", "name", word_list("name", "signature", "description").alias("words"))
    every = F.size(F.array_intersect("words", F.array(*map(F.lit, words)))) == len(words)
    return (
        held.where(every)
        .select("id", "name", F.round(cover_density(F.col("words"), words), 6).alias("rank"))
        .orderBy(F.desc("rank"), F.asc("name"), F.asc("id"))
        .limit(limit)
    )


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector(vectors: DataFrame, query: list[float], threshold: float = 0.5, limit: int = 100) -> DataFrame:
    """Exact search by cosine: vec_id, similarity, from the threshold on."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return (
        vectors.where(F.size("embedding") == len(query))
        .select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("similarity"))
        .where(F.col("similarity") >= threshold)
        .orderBy(F.desc("similarity"), F.asc("vec_id"))
        .limit(limit)
    )


def neighbours(queries: DataFrame, vectors: DataFrame, threshold: float = 0.5, limit: int = 100) -> DataFrame:
    """For every query vector its most similar rows: query_id, vec_id, similarity, from the threshold on.

    queries, vectors: vec_id, embedding. The queries come in blocks of at most
    ``QUERY_BLOCK``, each sent to all tasks as one matrix; a task multiplies its
    batches by it and hands on at most `limit` rows per query, so what is
    shuffled grows with queries and tasks, not with pairs.
    """
    wanted = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    base = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), "embedding")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    best = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas()
        part = _nearest(base, rows, threshold, limit)
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("vec_id"))
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def _nearest(base: DataFrame, rows: pd.DataFrame, threshold: float, limit: int) -> DataFrame:
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lengths = rows["embedding"].map(len) if len(rows) else pd.Series([], dtype=int)
    for n, group in rows.groupby(lengths):
        matrix = np.array(group["embedding"].tolist(), np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)
        by_length[int(n)] = (group["vec_id"].to_numpy(), matrix)
    sent = base.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        for pdf in batches:
            parts = [kept]
            for n, group in pdf.groupby(pdf["embedding"].map(len)):
                if int(n) not in sent.value:
                    continue
                ids, matrix = sent.value[int(n)]
                rows = np.array(group["embedding"].tolist(), np.float64)
                norms = np.linalg.norm(rows, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = np.round((rows @ matrix.T) / norms[:, None], 6)
                at, query = np.nonzero(cosine >= threshold)
                parts.append(pd.DataFrame({"query_id": ids[query], "vec_id": group["vec_id"].to_numpy()[at], "similarity": cosine[at, query]}))
            kept = pd.concat(parts).sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(limit)
        yield kept

    return base.mapInPandas(run, "query_id long, vec_id long, similarity double")


def of_ids(vectors: DataFrame, query: list[float], ids: DataFrame) -> DataFrame:
    """Similarity of the rows with given ids (id) to a vector, whatever it is."""
    q = F.array(*[F.lit(float(x)) for x in query])
    wanted = vectors.join(ids.select(F.col("id").alias("k")).distinct(), F.col("vec_id") == F.col("k"), "left_semi")
    return wanted.where(F.size("embedding") == len(query)).select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("similarity"))


def search(symbols: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The default search: full text, and lexical where that finds nothing; id, name and which of them it was."""
    found = fulltext(symbols, query, limit)
    if found.isEmpty():
        return lexical(symbols, query, limit).select("id", "name", F.lit("lexical").alias("way"))
    return found.select("id", "name", F.lit("fulltext").alias("way"))


def dispatch(symbols: DataFrame, mode: str, query: str, vectors: DataFrame | None = None, vector_of: list[float] | None = None, limit: int = 30) -> DataFrame:
    """Search by mode: exact (lexical), vector, qualified or auto; vector and qualified fall back to lexical.

    id, name and the way that gave the rows. A vector search needs the query's vector.
    """
    def ways(df: DataFrame, way: str) -> DataFrame:
        return df.select("id", "name", F.lit(way).alias("way"))

    if mode == "exact":
        return ways(lexical(symbols, query, limit), "lexical")
    if mode == "vector" and vectors is not None and vector_of:
        near = vector(vectors, vector_of, 0.0, limit).select(F.col("vec_id").alias("v_id"))
        found = symbols.join(near, F.col("id") == F.col("v_id"), "left_semi")
        if not found.isEmpty():
            return ways(found, "vector")
    if mode == "qualified":
        found = symbols.where(F.contains(F.lower(F.coalesce("qualified_name", F.lit(""))), F.lit(query.lower()))).orderBy("name", "id").limit(limit)
        if not found.isEmpty():
            return ways(found, "qualified")
    if mode == "auto":
        return search(symbols, query, limit)
    return ways(lexical(symbols, query, limit), "lexical")


def page(df: DataFrame, *order: Column, size: int = 1000, after: int = 0) -> DataFrame:
    """One page of ordered rows with the total beside each row; the size is held between 1 and 5000."""
    size = max(1, min(size, 5000))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(max(0, after)).limit(size)
    return rows.join(F.broadcast(total))


def hybrid(parts: dict[str, DataFrame], limit: int) -> DataFrame:
    """Weighted sum of rank scores of ranked parts (id, position from 0): id, score.

    A part's score falls from 1 to no less than 0.1 over its rows.
    """
    out = None
    for name, df in parts.items():
        total = Window.partitionBy(F.lit(1))
        scored = df.select("id", (F.greatest(F.lit(0.1), 1 - F.col("position") / F.count(F.lit(1)).over(total)) * WEIGHTS[name]).alias("part"))
        out = scored if out is None else out.unionByName(scored)
    return (
        out.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(limit)
    )


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """Rows of a limited result with their position in an order, from 0."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
