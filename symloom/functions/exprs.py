"""Column factories: path, name, framework and URL predicates used across operators.

All are plain JVM expressions, so they stay inside whole-stage code generation
and their filters reach the scan where the source supports it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to language (fixed values of the data model).
LANGUAGE_OF_EXTENSION = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "vue": "vue", "php": "php", "cs": "csharp", "gd": "gdscript", "tscn": "godot_scene", "py": "python",
}
#: Directories that are never scanned (fixed values).
SKIPPED_DIRECTORIES = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".nuxt", "vendor", "__pycache__", ".venv")


def extension(path: Column) -> Column:
    """Lower-case extension of a path, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]+)$", 1))


def language_of_path(path: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, extension(path)), F.lit("unknown"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_path(path: Column) -> Column:
    """Whether a path names a test file."""
    p = F.lower(F.coalesce(path, F.lit("")))
    return p.rlike(r"(^|/)(tests?|__tests__|specs?)/|\.(test|spec)\.[^/]+$|test\.(php|cs)$")


def is_generated_path(path: Column) -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    return p.rlike(r"\.(generated|g|designer)\.[^/]+$|(^|/)generated/|\.min\.[^/]+$|\.d\.ts$")


def in_skipped_directory(path: Column) -> Column:
    """Whether a directory of the path is one that scans leave out, hidden ones included."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(parts, lambda x: x.isin(*SKIPPED_DIRECTORIES) | ((F.length(x) > 1) & x.startswith(".")))


def glob_to_regex(pattern: str) -> str:
    """A glob of an ignore file as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif pattern.startswith("**", i):
            out += ".*"
            i += 2
        elif pattern[i] == "*":
            out += "[^/]*"
            i += 1
        elif pattern[i] == "?":
            out += "[^/]"
            i += 1
        else:
            out += "\\" + pattern[i] if pattern[i] in r".^$+{}[]|()\\" else pattern[i]
            i += 1
    head = "^" if pattern.startswith("/") else "(?:^|/)"
    return head + out.lstrip("/") + ("" if pattern.endswith("/") else "(?:/|$)")


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether ignore-file lines exclude a path; comments, blanks and negations are dropped.

    A line is a glob, or a regular expression between "/regex:" and "/".
    """
    wanted = [x.strip() for x in lines if x.strip() and x.strip()[0] not in "#!"]
    patterns = [x[7:-1] if x.startswith("/regex:") and x.endswith("/") else glob_to_regex(x) for x in wanted]
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def glob_to_like(pattern: str) -> str:
    """A shell glob as a LIKE pattern with backslash as escape."""
    out = ""
    for c in pattern:
        out += {"\\": "\\\\", "%": "\\%", "_": "\\_", "*": "%", "?": "_"}.get(c, c)
    return out


def contains_ci(column: Column, text: str) -> Column:
    """Case-insensitive substring test in which % and _ have no meaning."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(text.lower()))


def framework_is(framework: str, language: Column, path: Column) -> Column:
    """Files of a framework by language or path."""
    lang, p = F.lower(F.coalesce(language, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    rules = {
        "laravel": (lang == "php") | p.endswith(".php"),
        "vue": (lang == "vue") | p.endswith(".vue"),
        "react": p.rlike(r"\.(jsx|tsx)$"),
        "node": lang.isin("javascript", "typescript") & ~p.endswith(".vue"),
        "godot": (lang == "csharp") | p.rlike(r"\.(gd|cs|tscn)$"),
    }
    return rules[framework]


def normal_url(url: Column) -> Column:
    """Canonical form of an endpoint: lower case, no query, no outer slashes, one sign for parameters."""
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""))
    u = F.regexp_replace(u, r"\$\{[^}]*\}|\{[^}]*\}|:[a-z_]\w*", "{param}")
    return F.regexp_replace(F.regexp_replace(u, r"/+", "/"), r"^/|/$", "")


def segments(url: Column) -> Column:
    return F.split(normal_url(url), "/")


def is_callable(symbol_type: Column) -> Column:
    return symbol_type.isin("function", "method", "constructor")


def feature_name(name: Column) -> Column:
    """Name of a feature: without leading verb and trailing kind, first letter capital."""
    core = F.regexp_replace(name, r"^(get|set|create|update|delete|fetch|load|save|handle|process|use)(?=[A-Z])", "")
    core = F.regexp_replace(core, r"(?<=.)(Controller|Service|Component|Store|Model|Handler|Manager|Repository)$", "")
    return F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 10_000))
