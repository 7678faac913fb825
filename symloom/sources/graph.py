"""The code graph: current rows of each table, as DataFrames and as SQL for the twins.

Every view is one aggregate by key over the columns a query asks for, so a scan
reads those columns only and repeated rows collapse before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.sources.tables import latest, table

#: Views: (table, columns that are kept).
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "s": ("symbols", ("file_id", "name", "qualified_name", "parent_symbol_id", "symbol_type", "entity_type", "framework", "base_class", "signature", "description", "start_line", "end_line", "is_exported", "visibility", "namespace")),
    "f": ("files", ("repo_id", "path", "language", "size", "last_modified", "git_hash", "content_hash", "is_generated", "is_test")),
    "d": ("dependencies", ("from_symbol_id", "to_symbol_id", "dependency_type", "to_qualified_name", "from_symbol", "to_symbol", "line_number", "created_at", "calling_object", "resolved_class", "qualified_context", "method_signature", "namespace_context", "parameter_context", "call_instance_id", "parameter_types")),
    "a": ("api_calls", ("repo_id", "caller_symbol_id", "endpoint_symbol_id", "http_method", "endpoint_path", "line_number", "call_type", "created_at", "raw_call")),
    "r": ("repositories", ("name", "path", "language_primary", "framework_stack", "last_indexed", "git_hash")),
    "b": ("build_errors", ("repo_id", "file_path", "message", "created_at")),
    "x": ("framework_symbols", ("framework", "name", "qualified_name", "symbol_type")),
}
_STATIC = {"r", "b", "x"}


def view(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One view with id and the named columns (all of them when none is named)."""
    source, known = VIEWS[name]
    wanted = list(columns or known)
    df = table(spark, folder, source)
    if name in _STATIC:
        return df.select("id", *wanted)
    # ties of updated_at are settled by the columns asked for, in one order, so no other column is read
    in_order = [c for c in known if c in wanted]
    return latest(df, "id", [F.col("updated_at").alias("_order")], in_order).select("id", *wanted)


def view_sql(name: str, *columns_: str) -> str:
    """The same view as a common table expression."""
    source, known = VIEWS[name]
    known = columns_ or known
    columns = ", ".join(known)
    if name in _STATIC:
        return f"{name} AS (SELECT id, {columns} FROM {source})"
    in_order = [c for c in VIEWS[name][1] if c in known]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("updated_at", *in_order))
    return f"{name} AS (SELECT id, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS rn_ FROM {source} WHERE id IS NOT NULL) WHERE rn_ = 1)"


class Graph:
    """The views of one data folder: g.s("name") is the symbols with id and name, and so on for every view."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str):
        if name not in VIEWS:
            raise AttributeError(name)
        return lambda *columns: view(self.spark, self.folder, name, *columns)

    def table(self, name: str) -> DataFrame:
        """A table as it is, repeats included."""
        return table(self.spark, self.folder, name)

    def prefixed(self, name: str, prefix: str, *columns: str) -> DataFrame:
        """A view with a prefix before all of its columns, for joins with others of its kind."""
        df = view(self.spark, self.folder, name, *columns)
        return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])

    def placed(self, prefix: str = "", symbols: tuple[str, ...] = ("name",), files: tuple[str, ...] = ("path",)) -> DataFrame:
        """Symbols with columns of their file beside them; symbols without a file have nulls there."""
        s = self.prefixed("s", prefix, "file_id", *symbols)
        f = self.prefixed("f", f"{prefix}f_", *files)
        return s.join(f, F.col(f"{prefix}file_id") == F.col(f"{prefix}f_id"), "left")
