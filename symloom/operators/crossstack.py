"""Frontend calls against backend endpoints, by a canonical form of their URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.exprs import normal_url

#: URLs with one segment in one place that a task compares with all others that have it.
SALT = 2_000


def normal_calls(calls: DataFrame) -> DataFrame:
    """Calls with method in capitals and canonical URL."""
    return calls.withColumns({"method": F.upper(F.coalesce("http_method", F.lit("GET"))), "url": normal_url(F.col("endpoint_path"))})


def routes(calls: DataFrame) -> DataFrame:
    """Distinct endpoints with their calls; endpoints are what calls resolve to."""
    return (
        normal_calls(calls)
        .groupBy("method", "url")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_distinct("caller_symbol_id").alias("callers"),
            F.min("endpoint_symbol_id").alias("handler_id"),
        )
    )


def matched(calls: DataFrame) -> DataFrame:
    """Calls without an endpoint, with the handler other calls of the same URL and method have."""
    known = routes(calls).where("handler_id is not null").select("method", "url", "handler_id")
    return (
        normal_calls(calls)
        .where("endpoint_symbol_id is null")
        .join(known, ["method", "url"], "left")
        .select("id", "method", "url", "handler_id")
    )


def coverage(calls: DataFrame, repositories: DataFrame) -> DataFrame:
    """URLs that are called from frontend repositories only, from others only, or from both."""
    front = F.coalesce("language_primary", F.lit("")).isin("javascript", "typescript", "vue")
    sides = repositories.select(F.col("id").alias("r_id"), front.alias("front"))
    urls = normal_calls(calls).where("url <> ''").join(sides, F.col("repo_id") == F.col("r_id"))
    seen = urls.groupBy("method", "url").agg(F.bool_or("front").alias("a"), F.bool_or(~F.col("front")).alias("b"))
    state = F.when(~F.col("a"), "second_only").when(~F.col("b"), "first_only").otherwise("both")
    return seen.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("urls"))


#: Names that mean the same parameter (fixed values).
ALIASES = (
    ("id", "userid", "user_id"), ("slug", "permalink", "name"), ("page", "pagenumber", "page_number"), ("limit", "pagesize", "page_size", "size"), ("offset", "skip"),
)
#: Parts of the similarity of two URLs (fixed values).
STATIC, PARAMETER, COMPATIBLE = 0.6, 0.3, 0.1


def url_pattern(url: Column) -> Column:
    """A URL as written in code as a struct: normalized, parameters (names in order), query (names), is_static.

    Takes template literals, {name} and {name?}, and 'a' + name + 'b'; a null
    URL has an empty form and is not static.
    """
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.regexp_replace(u, r"^`(.*)`$", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"/+", "/"), r"(?<=.)/$", "")
    u = F.regexp_replace(u, r"\$\{\s*([^}]*?)\s*\}", "{$1}")
    u = F.regexp_replace(u, r"\{([^}?]*)\?([^}]*)\}", "{$1$2}")
    u = F.regexp_replace(u, r"['\"`]\s*\+\s*([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\+\s*['\"`]", "{$1}")
    base = F.regexp_extract(u, r"^([^?]*)", 1)
    names = F.array_distinct(F.regexp_extract_all(u, F.lit(r"\{([^}]*)\}"), 1))
    query = F.when(F.contains(u, F.lit("?")), F.regexp_extract_all(F.regexp_extract(u, r"\?(.*)$", 1), F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*)"), 1)).otherwise(F.array().cast("array<string>"))
    return F.struct(base.alias("normalized"), names.alias("parameters"), query.alias("query"), ((F.size(names) == 0) & (F.size(query) == 0) & (F.coalesce(url, F.lit("")) != "")).alias("is_static"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two parameter names can mean the same: equal, aliases, other spelling, same root, or both an id."""
    x, y = F.lower(a), F.lower(b)
    alias = F.lit(False)
    for group in ALIASES:
        alias = alias | (x.isin(*group) & y.isin(*group))
    root = lambda c: F.lower(F.regexp_replace(c, r"(?i)(?:_id|Id)$", ""))
    return (a == b) | alias | (x == F.replace(y, F.lit("_"), F.lit(""))) | ((root(a) == root(b)) & (F.length(root(a)) > 2)) | (x.endswith("id") & y.endswith("id"))


def _is_parameter(segment: Column) -> Column:
    return segment.startswith("{") & segment.endswith("}")


def url_score(a: Column, b: Column) -> Column:
    """Similarity of two segment arrays of one length, with three decimals."""
    def share(test) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(test(x, y), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)

    both = lambda x, y: (x != y) & _is_parameter(x) & _is_parameter(y)
    inner = lambda x: F.regexp_replace(x, r"^\{|\}$", "")
    n, static, pairs = F.greatest(F.size(a), F.lit(1)), share(lambda x, y: x == y), share(both)
    fitting = share(lambda x, y: both(x, y) & compatible(inner(x), inner(y)))
    fit = F.when(pairs > 0, fitting / pairs).otherwise(F.lit(1.0))
    return F.when(F.array_join(a, "/") == F.array_join(b, "/"), F.lit(1.0)).otherwise(F.round(static / n * STATIC + pairs / n * PARAMETER + fit * COMPATIBLE, 3))


def match_type(score: Column, parameters: Column) -> Column:
    """Kind of a match by its score; parameters tells whether either URL has some."""
    return (
        F.when((score >= 0.95) & ~parameters, "exact").when(score >= 0.7, "parameters").when(score >= 0.5, "structure").when(score >= 0.3, "partial").otherwise("none")
    )


def blocked_pairs(left: DataFrame, right: DataFrame, least: Callable[[Column], Column]) -> DataFrame:
    """Pairs of URLs of one method and length of which at least so many places are alike: a.*, b.* as structs.

    left, right: method, parts. Places are alike when the segments are equal or
    both parameters. Of two URLs that are alike in k of n places, the n - k + 1
    rarest segments of each, in one order for all, share one; so only these are
    joined, and a pair is taken at the rarest segment it shares. Segments that
    many URLs have are salted by their count. No pair is lost.
    """
    def held(df: DataFrame) -> DataFrame:
        kinds = F.transform("parts", lambda x: F.when(_is_parameter(x), "{}").otherwise(x))
        return df.withColumns({"kinds": kinds, "n": F.size("parts"), "row": F.struct(*[F.col(c) for c in df.columns])}).select("row", "method", "n", "kinds")

    a, b = held(left), held(right)
    places = [df.select("method", "n", F.posexplode("kinds").alias("at", "part")) for df in (a, b)]
    common = places[0].unionByName(places[1]).groupBy("method", "n", "at", "part").agg(F.count(F.lit(1)).alias("urls"))

    def rarest(df: DataFrame) -> DataFrame:
        tokens = F.sort_array(F.collect_list(F.struct("urls", "at", "part")))
        return (
            df.select("row", "method", "n", F.posexplode("kinds").alias("at", "part"))
            .join(common, ["method", "n", "at", "part"])
            .groupBy("row", "method", "n")
            .agg(tokens.alias("tokens"))
            .withColumn("tokens", F.slice("tokens", 1, F.greatest(F.lit(1), F.col("n") - least(F.col("n")) + 1)))
            .withColumn("token", F.explode("tokens"))
            .withColumn("salts", F.ceil(F.col("token.urls") / SALT).cast("int"))
        )

    x = rarest(a).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).alias("x")
    y = rarest(b).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("method", "n", "token", "salt")]
    first = F.element_at(F.array_intersect("x.tokens", "y.tokens"), 1) == F.col("x.token")
    return x.join(y, on).where(first).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"))


def _patterns(calls: DataFrame) -> DataFrame:
    """Distinct (method, normalized) with segments."""
    pattern = url_pattern(F.col("endpoint_path"))
    return (
        calls.select(F.upper(F.coalesce("http_method", F.lit("GET"))).alias("method"), pattern["normalized"].alias("url"))
        .where("url <> ''")
        .distinct()
        .withColumn("parts", F.filter(F.split("url", "/"), lambda s: s != ""))
        .where(F.size("parts") > 0)
    )


def similar(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of URLs of two sets of calls with a score from the threshold (at least 0.4) on.

    method, url_a, url_b, score, match_type. The score of k alike places of n is
    at most STATIC * k / n + COMPATIBLE, which bounds k from below.
    """
    if threshold < 0.4:
        raise ValueError("below 0.4 pairs need not share any place")
    least = lambda n: F.greatest(F.lit(1), F.ceil(F.round(n * ((threshold - COMPATIBLE - 0.0005) / STATIC), 9)).cast("int"))
    pairs = blocked_pairs(_patterns(left), _patterns(right), least)
    score = url_score(F.col("a.parts"), F.col("b.parts"))
    has = F.exists("a.parts", _is_parameter) | F.exists("b.parts", _is_parameter)
    return (
        pairs.select(F.col("a.method").alias("method"), F.col("a.url").alias("url_a"), F.col("b.url").alias("url_b"), score.alias("score"), match_type(score, has).alias("match_type"))
        .where(F.col("score") >= threshold)
    )


def basic_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """The fallback: pairs of one method of which more than 0.3 of the common places are equal; method, url_a, url_b, score.

    Pairs meet on (method, place, segment) of an equal place; segments that many
    URLs have are salted by their count.
    """
    def places(df: DataFrame) -> DataFrame:
        return _patterns(df).select("method", "url", "parts", F.posexplode("parts").alias("at", "part"))

    a, b = places(left), places(right)
    common = a.groupBy("method", "at", "part").agg(F.count(F.lit(1)).alias("urls"))
    salts = F.ceil(F.col("urls") / SALT).cast("int")
    x = a.join(common, ["method", "at", "part"]).withColumn("salt", F.pmod(F.xxhash64("url"), salts).cast("int")).drop("urls")
    y = b.join(common, ["method", "at", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("urls")
    return (
        x.select("method", "at", "part", "salt", F.col("url").alias("url_a"), F.size("parts").alias("n_a"))
        .join(y.select("method", "at", "part", "salt", F.col("url").alias("url_b"), F.size("parts").alias("n_b")), ["method", "at", "part", "salt"])
        .groupBy("method", "url_a", "url_b")
        .agg((F.count(F.lit(1)) / F.least(F.first("n_a"), F.first("n_b"))).alias("share"))
        .where("share > 0.3")
        .select("method", "url_a", "url_b", F.round(F.col("share") * 0.6, 6).alias("score"))
    )


def best_matches(calls: DataFrame, repositories: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of every frontend URL the best backend one: method, url, route, score, match_type; without a match the last three are null."""
    front, back = sides(calls, repositories)
    pairs = similar(front, back, threshold)
    best = pairs.groupBy("method", "url_a").agg(F.min(F.struct((-F.col("score")).alias("s"), "url_b", "match_type")).alias("best"))
    urls = _patterns(front).select("method", F.col("url").alias("url"))
    return urls.join(best, (urls["method"] == best["method"]) & (F.col("url") == F.col("url_a")), "left").select(
        urls["method"], "url", F.col("best.url_b").alias("route"), (-F.col("best.s")).alias("score"), F.col("best.match_type").alias("match_type")
    )


def sides(calls: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls of repositories whose language is one of frontends, and those of all others."""
    front = F.coalesce("language_primary", F.lit("")).isin("javascript", "typescript", "vue")
    marked = calls.join(repositories.select(F.col("id").alias("r_id"), front.alias("front")), F.col("repo_id") == F.col("r_id"))
    return marked.where("front"), marked.where("not front")
