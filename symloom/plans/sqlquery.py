"""Operators bound to parameters, and the SQL twins they are compared with.

A twin names views as {s}, {f}, {d} and so on; each becomes a common table
expression with the columns the text mentions. RX, LISTAGG, MONTH and STRUCTOF
stand for what the dialect of the twins calls differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symloom.sources.graph import VIEWS, Graph, view_sql

_VIEW = re.compile(r"\{(\w+)\}")


def bound(operator: Callable[..., DataFrame], *arguments, **parameters) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query: an operator on the graph of a folder with its parameters."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return operator(Graph(spark, folder), *arguments, **parameters)

    run.__name__ = operator.__name__
    return run


def _dialect(text: str) -> str:
    text = re.sub(r"\bRX\(", "regexp_matches(", text)
    text = re.sub(r"STRUCTOF\(((?:[^()]|\([^()]*\))*)\)", lambda m: "struct_pack(" + re.sub(r"((?:[^,()]|\([^()]*\))+) AS (\w+)", r"\2 := \1", m[1]) + ")", text)
    text = re.sub(r"LISTAGG\((.*?) BY (\w+)\)", r"string_agg(\1, ', ' ORDER BY \2)", text)
    return re.sub(r"MONTH\((\w+)\)", r"strftime(\1, '%Y-%m')", text)


def _used(name: str, text: str) -> list[str]:
    """Columns of a view that a text mentions."""
    return [c for c in VIEWS[name][1] if re.search(rf"\b{c}\b", text)] or [VIEWS[name][1][0]]


def twin(ctes: str, select: str) -> str:
    names = dict.fromkeys(_VIEW.findall(ctes + select))
    parts = [view_sql(n, *_used(n, ctes + " " + select)) for n in names if n in VIEWS]
    if ctes:
        parts.append(_dialect(_VIEW.sub(r"\1", ctes)))
    head = f"WITH RECURSIVE {', '.join(parts)} " if parts else ""
    return head + _dialect(_VIEW.sub(r"\1", select))


def twins(texts: dict[str, tuple[str, str] | str]) -> dict[str, str]:
    """SQL of each name, from select or (ctes, select)."""
    return {name: twin(*(("", text) if isinstance(text, str) else text)) for name, text in texts.items()}
