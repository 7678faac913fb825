"""Syntax, functions and documentation of source files, as DataFrame operators.

Each is one pass of Python over the texts, Arrow batch by Arrow batch, with no
shuffle but the one that spreads a small scan over all cores.

Defined cases: a null or blank content does not parse for PHP and Vue, which
need code, and parses as an empty script for the others; a language that is null
or unknown is taken from the path's extension, and where that says nothing the
file is reported with accepted = null; extra columns are left out; repeated rows
give repeated results.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.syntax import csharp, ecma, php, vue
from symloom.llm.syntax import functions as fn
from symloom.llm.syntax.base import deep
from symloom.session import spread

#: Extensions of each language (fixed).
EXTENSIONS = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "typescript", "php": "php", "cs": "csharp", "vue": "vue",
}
LANGUAGES = frozenset(EXTENSIONS.values())
#: Extensions of files that may hold JSX elements (fixed).
ELEMENTS = ("jsx", "tsx")


def language_of(language: object, path: object) -> str:
    """The language to read a file as, or an empty text."""
    named = language.strip().lower() if isinstance(language, str) else ""
    if named in LANGUAGES:
        return named
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), "") if isinstance(path, str) and "." in path else ""


def has_elements(path: object) -> bool:
    """Whether a file of that name may hold JSX elements."""
    return isinstance(path, str) and path.rsplit(".", 1)[-1].lower() in ELEMENTS


def language_column(language: str, path: str) -> Column:
    """The same as a column; null where nothing is known."""
    named = F.lower(F.trim(F.col(language)))
    of_extension = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    extension = F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([^.]*)$", 1))
    return F.when(named.isin(*sorted(LANGUAGES)), named).otherwise(F.try_element_at(of_extension, extension))


def syntax_errors(text: str, language: str, path: object = "") -> list[tuple[str, int]]:
    """All errors of a text as (message, offset) in the order of the text; the path tells whether elements are allowed."""
    if text.startswith("\ufeff") and language != "vue":
        text = " " + text[1:] if language != "php" else text
    with deep():
        if language == "php":
            return php.parse(text)
        if language == "csharp":
            return csharp.parse(text)
        if language == "vue":
            return vue.parse(text)
        return ecma.parse(text, language == "typescript", has_elements(path))


_PARSED = "file_id long, repo_id long, path string, language string, accepted boolean, errors int, message string, line int, offset int, all_errors array<struct<message:string,line:int,offset:int>>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, repo_id, path, language, text in zip(
            pdf["file_id"], pdf["repo_id"], pdf["path"], pdf["language"], pdf["content"], strict=True
        ):
            lang = language_of(language, path)
            text = text if isinstance(text, str) else ""
            if not lang:
                rows.append((file_id, repo_id, path, None, None, 0, None, None, None, []))
                continue
            errors = syntax_errors(text, lang, path)
            lines = fn._lines(text) if errors else []
            found = [{"message": m, "line": bisect.bisect_right(lines, at), "offset": at} for m, at in errors]
            first = found[0] if found else {"message": None, "line": None, "offset": None}
            rows.append((file_id, repo_id, path, lang, not found, len(found), first["message"], first["line"], first["offset"], found))
        yield pd.DataFrame(
            rows, columns=["file_id", "repo_id", "path", "language", "accepted", "errors", "message", "line", "offset", "all_errors"]
        ).astype({"file_id": "Int64", "repo_id": "Int64", "line": "Int32", "offset": "Int32", "accepted": "boolean"})


def _base(sources: DataFrame) -> DataFrame:
    return sources.select(
        F.col("file_id").cast("long"),
        F.col("repo_id").cast("long"),
        F.col("path").cast("string"),
        F.col("language").cast("string"),
        F.col("content").cast("string"),
    )


def parse_sources(sources: DataFrame) -> DataFrame:
    """Per file whether it parses, its first error and all errors with their lines."""
    return spread(_base(sources)).mapInPandas(_parse, _PARSED)


def failure_rates(parsed: DataFrame, *keys: str) -> DataFrame:
    """Files, files that do not parse and their rate per key; files of unknown language are left out."""
    return (
        parsed.where("accepted is not null")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("accepted")).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )


def reported(parsed: DataFrame, errors: DataFrame) -> DataFrame:
    """Files that do not parse with what the build said of them, if it said anything.

    Paths are compared by repository without leading dots, slashes and case, and
    with one kind of slash.
    """

    def plain(column: str):
        slashes = F.regexp_replace(F.lower(F.trim(column)), r"[\\/]+", "/")
        return F.regexp_replace(slashes, r"^(?:\./|/)+", "")

    said = (
        errors.where("file_path is not null")
        .groupBy(F.col("repo_id").alias("e_repo"), plain("file_path").alias("e_path"))
        .agg(F.count(F.lit(1)).alias("reports"), F.max_by("message", "created_at").alias("last_message"))
    )
    bad = parsed.where("not accepted").withColumn("plain", plain("path"))
    return bad.join(said, (F.col("repo_id") == F.col("e_repo")) & (F.col("plain") == F.col("e_path")), "left").select(
        "file_id", "repo_id", "path", "language", "message", "line", F.coalesce("reports", F.lit(0)).alias("reports"), "last_message"
    )


#: Type of the pairs of one file.
PAIRS = "array<struct<language: string, name: string, start_line: int, end_line: int, signature: string, description: string, code: string>>"


def _pairs_of(text: object, lang: str, path: object) -> list[dict]:
    if not lang or not isinstance(text, str):
        return []
    out = []
    for f in fn.functions(text, lang, has_elements(path)):
        said = fn.describes(f.doc, f.name) if f.doc else ""
        if said:
            head = " ".join(text[f.head : f.body].split())
            out.append({"language": lang, "name": f.name, "start_line": f.start_line, "end_line": f.end_line, "signature": head, "description": said, "code": text[f.head : f.end]})
    return out


def pairs(pdf: pd.DataFrame) -> list[list[dict]]:
    """Of each text that parses its functions with their documentation."""
    return [
        _pairs_of(text, lang, path) if lang and isinstance(text, str) and not syntax_errors(text, lang, path) else []
        for text, lang, path in zip(pdf["content"], map(language_of, pdf["language"], pdf["path"]), pdf["path"], strict=True)
    ]


def documented_functions(sources: DataFrame) -> DataFrame:
    """Functions and methods with a body, each with the prose of the comment above its head.

    Null and unknown languages give no rows, nor do functions whose comment is
    missing, shorter than five words, a repetition of the name or a placeholder.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            languages = map(language_of, pdf["language"], pdf["path"])
            found = [_pairs_of(t, lang, p) for t, lang, p in zip(pdf["content"], languages, pdf["path"], strict=True)]
            yield pd.DataFrame({"file_id": pdf["file_id"].astype("Int64"), "repo_id": pdf["repo_id"].astype("Int64"), "beside": pd.Series(found, pdf.index, object)})

    return exploded(spread(_base(sources)).mapInPandas(run, f"file_id long, repo_id long, beside {PAIRS}"))


def exploded(found: DataFrame) -> DataFrame:
    """One row per pair from a column of pairs."""
    return found.select("file_id", "repo_id", F.explode("beside").alias("pair")).select("file_id", "repo_id", "pair.*")
