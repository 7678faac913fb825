"""Generated, minified, bundled or vendored files and data saved as code.

Three passes over the texts. The first takes numbers of each file (compression
ratio, token entropy, identifier lengths, comment density and the like) and the
hashes of its line windows; leading comments, where notices stand, are cut off
before, so no number knows of a notice, and of a component with markup its
scripts are measured. The second counts in how many
repositories each window stands, which tells copies however they are named and
even where some of their lines were changed. A random forest then learns from
the files whose notice says who wrote them, and its score alone decides on all
files, those with a notice included.

Labels: a notice of a tool or a licence under which others may use a project is
a 1, a remark that a file is written by hand or kept for internal use a 0. A
copyright line says nothing, as own files carry it too. Files of literals carry
no notices; their structure labels them as a 1, so that the forest sees them.

Defined cases: a null or blank content is no file of any kind and is never
flagged; a row with a null id is kept with that id; repeated rows give repeated
results; without files of both labels nothing is flagged.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.forest import Forest
from symloom.session import cut, spread

#: Labelled files of each label that the forest is fitted on, chosen by a hash of the content.
FIT_ROWS = 4_000
#: Lines in a window whose repeats in other repositories count as copying.
WINDOW = 6
#: Characters that a window holds at least; shorter ones are everybody's code.
WINDOW_CHARS = 150

_LEAD = re.compile(
    r"\A(?:﻿|\s|<\?php\b|(['\"])use strict\1;?|#![^\n]*|/\*.*?(?:\*/|\Z)|//[^\n]*|#(?!\[)[^\n]*|<!--.*?-->)*", re.S
)
_COMPONENT = re.compile(r"<(?:template|script|style)\b", re.I)
_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)(?:</script\s*>|\Z)", re.S | re.I)
_COMMENT = re.compile(r"(/\*.*?(?:\*/|\Z)|(?<![:\"'\w])//[^\n]*|^[ \t]*#(?!\[)[^\n]*|<!--.*?-->)", re.S | re.M)
#: Notices of tools (common phrases of code generators and bundlers).
_TOOL = re.compile(
    r"^\W*@generated\b|<auto-?generated|^\W*auto-?generated\b|^\W*(?:this (?:file|code) (?:was|is) |code )?(?:auto(?:matically|-)?\s*)?generated (?:by|from|on|with|using)\b|"
    r"produced by the \S+(?: \S+)? (?:compiler|generator|tool)|machine[- ]written|machine[- ]generated|^\W*output of\b|wird beim bauen erzeugt|automatisch (?:erzeugt|generiert)|"
    r"(?:code|file) generated by|do not (?:edit|modify)\s*(?:[.!;*\n]|$|by hand|manually|this file)|changes will be lost|rerun the tool|^/\*! \w+ bundle \*/",
    re.I | re.M,
)
#: Notices under which a project is given to others (common phrases of licences).
_PROJECT = re.compile(
    r"@license\b|\bv?\d+\.\d+\.\d+ \| [\w.-]+ licen[cs]e|redistribution (?:and use|is permitted)|permission is hereby granted|licensed under the \S+ licen[cs]e|\b(?:MIT|BSD|ISC|Apache)(?:-[\d.]+)? licen[cs]e",
    re.I,
)
#: Remarks that a file is one's own (common phrases).
_OWN = re.compile(
    r"\b(?:written|edited|maintained|kept|updated) (?:by hand|manually)|\bhand-?written\b|internal use only|\bproprietary\b|licen[cs]e file (?:of|in|at) (?:this|the) (?:repository|project|root)",
    re.I,
)
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\s\w]")
_NAME = re.compile(r"[^\W\d]\w*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|-?\d[\d.eE+-]*|\b(?:true|false|null)\b")
_CALLABLE = re.compile(r"\b(?:function|class|fn|=>|return|if|for|while|foreach|switch)\b|=>")

FEATURES = (
    "ratio", "entropy", "name_mean", "name_short", "name_long", "comments", "comment_lines", "longest", "line_mean", "blank", "digits", "marks", "strings",
    "unique_lines", "unique_names", "literals", "callables", "same_start", "shape_share", "copied", "copies",
)


def script(text: str) -> str:
    """The code to judge: of a single-file component its scripts, if it has any, of other files all."""
    rest = text[_LEAD.match(text).end() :]
    if _COMPONENT.match(rest):
        return "\n".join(_SCRIPT.findall(rest)) or text
    return text


def label(text: str) -> int:
    """1 a notice of a tool or another project, 0 one of the people here, -1 none."""
    code = script(text)
    lead = _LEAD.match(text)[0]
    if code is not text:
        lead += "\n" + _LEAD.match(code)[0]
    if _TOOL.search(lead) or _PROJECT.search(lead) or re.search(r"^//# sourceMappingURL=", text[-200:], re.M):
        return 1
    return 0 if _OWN.search(lead) else -1


def body(text: str) -> str:
    """The code without its leading comments and source map line, with line feeds only."""
    code = script(text)
    rest = code[_LEAD.match(code).end() :]
    rest = re.sub(r"^//# sourceMappingURL=.*$", "", rest, flags=re.M)
    return rest.replace("\r\n", "\n").replace("\r", "\n")


@functools.lru_cache(maxsize=2)
def prepared(text: str) -> tuple[str, list[str], str]:
    """The code to judge, its comments, and the code without them; a text is taken apart once for all that measures it."""
    code = body(text)
    parts = _COMMENT.split(code)
    return code, parts[1::2], " ".join(parts[::2])


def measure(text: str) -> list[float]:
    """The numbers of one file that need no other file."""
    code, comments, bare = prepared(text)
    raw = code.encode("utf-8", "replace")
    n = max(1, len(code))
    counts = Counter(_TOKEN.findall(bare))
    total = max(1, sum(counts.values()))
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    plain, strings = bare, _STRING.findall(bare)
    if strings:
        plain = _STRING.sub(" ", bare)
    names = _NAME.findall(plain)
    lengths = np.array([len(x) for x in names] or [0])
    lines = [x.strip() for x in code.split("\n")]
    full = [x for x in lines if x]
    # shapes of all lines at once: no replacement reaches over a line feed
    shapes = Counter(re.sub(r"\d+", "0", re.sub(r"[A-Za-z_]\w*", "a", "\n".join(full))).split("\n")) if full else {}
    starts = Counter(x.split(" ", 2)[0][:12] for x in full)
    literal = sum(map(len, _LITERAL.findall(bare)))
    digits = sum(map(code.count, "0123456789")) if code.isascii() else sum(map(str.isdigit, code))
    return [
        len(zlib.compress(raw, 6)) / max(1, len(raw)),
        entropy / math.log2(total + 1),
        float(lengths.mean()),
        float((lengths <= 2).mean()),
        float((lengths >= 12).mean()),
        sum(map(len, comments)) / n,
        len(comments) / max(1, len(full)),
        math.log1p(max(map(len, lines), default=0)),
        math.log1p(len(code) / max(1, len(full))),
        1 - len(full) / max(1, len(lines)),
        digits / n,
        sum(c for t, c in counts.items() if not (t[0].isalnum() or t[0] == "_")) / total,
        sum(map(len, strings)) / n,
        len(set(full)) / max(1, len(full)),
        len(set(names)) / max(1, len(names)),
        literal / n,
        len(_CALLABLE.findall(bare)) / total,
        max(starts.values(), default=0) / max(1, len(full)),
        max(shapes.values(), default=0) / max(1, len(full)),
    ]


def windows(text: str) -> list[int]:
    """Hashes of runs of lines of code, for finding the same run in other repositories; comments do not count."""
    full = [x for x in (" ".join(x.split()) for x in prepared(text)[2].split("\n")) if len(x) > 1]
    # a run is told by the hashes of its lines
    raws = [x.encode("utf-8", "replace") for x in full]
    marks = [zlib.crc32(r).to_bytes(4) + zlib.adler32(r).to_bytes(4) for r in raws]
    sizes = [len(x) + 1 for x in full]
    out = set()
    for i in range(max(1, len(full) - WINDOW + 1)):
        if sum(sizes[i : i + WINDOW]) > WINDOW_CHARS:
            run = b"".join(marks[i : i + WINDOW])
            out.add((zlib.crc32(run) << 31) ^ zlib.adler32(run))
    return list(out)


def is_data(numbers: list[float], text: str) -> bool:
    """A text of literals: they fill half of it, and nothing is called, tested or returned."""
    if numbers[FEATURES.index("literals")] < 0.5:
        return False
    code = prepared(text)[2]
    return bool(code.strip()) and not re.search(r"\w\s*\(|=>|\b(?:function|return|if|for|while|switch)\b", _STRING.sub("''", code))


#: Something else to take from each text in the pass that measures it: a batch in, one value per row out.
Beside = Callable[[pd.DataFrame], list]


def first_pass(sources: DataFrame, beside: Beside | None = None, kind: str = "") -> DataFrame:
    """Per file its label, its numbers and its windows, and beside them what else is asked for, as a table.

    kind is the type of the column beside.
    """
    columns = [F.col("file_id").cast("long"), F.col("repo_id").cast("long"), F.col("content").cast("string")]
    if beside is not None:
        columns += [F.col("path").cast("string"), F.col("language").cast("string")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.loc[np.array([isinstance(t, str) and bool(t.strip()) for t in pdf["content"]], bool)]
            texts = pdf["content"].tolist()
            numbers = [measure(t) for t in texts]
            data = [is_data(n, t) for n, t in zip(numbers, texts, strict=True)]
            out = {
                "file_id": pdf["file_id"].astype("Int64"),
                "repo_id": pdf["repo_id"].astype("Int64"),
                "label": [1 if d else label(t) for d, t in zip(data, texts, strict=True)],
                "data": data,
                "numbers": pd.Series(numbers, pdf.index, object),
                "windows": pd.Series([windows(t) for t in texts], pdf.index, object),
            }
            if beside is not None:
                out["beside"] = pd.Series(beside(pdf), pdf.index, object)
            yield pd.DataFrame(out, index=pdf.index)

    schema = "file_id long, repo_id long, label int, data boolean, numbers array<double>, windows array<long>"
    return cut(spread(sources.select(*columns)).mapInPandas(run, schema + (f", beside {kind}" if beside else "")))


def measured(first: DataFrame) -> DataFrame:
    """Per file its label, its numbers and the copying seen across repositories.

    Adds to the numbers the share of line windows that stand in another
    repository too, and the logarithm of the greatest number of files with one
    window. Window statistics are partial sums before they are shuffled, and
    only windows of several repositories are joined back; a window of very many
    files is a skewed key of that join, whose sides Spark splits as it runs.
    """
    runs = first.select("file_id", F.coalesce("repo_id", F.lit(-1)).alias("repo"), F.explode("windows").alias("run"))
    spreaded = (
        runs.groupBy("run")
        .agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.count(F.lit(1)).alias("files"))
        .where("a <> b")
        .select(F.col("run").alias("r_run"), "files")
    )
    copied = (
        runs.join(spreaded, F.col("run") == F.col("r_run"))
        .groupBy(F.col("file_id").alias("c_file"))
        .agg(F.count_distinct("run").alias("shared"), F.max("files").alias("files"))
    )
    share = F.coalesce(F.col("shared") / F.greatest(F.size("windows"), F.lit(1)), F.lit(0.0))
    return first.join(copied, F.col("file_id") == F.col("c_file"), "left").select(
        "file_id",
        "repo_id",
        "label",
        "data",
        F.concat("numbers", F.array(share, F.log1p(F.coalesce("files", F.lit(0)).cast("double")))).alias("numbers"),
    )


def fit(numbers: DataFrame, rows: int = FIT_ROWS) -> Forest | None:
    """Fit on at most `rows` labelled files per label, the ones with the smallest hash."""
    labelled = numbers.where("label >= 0")
    order = F.xxhash64("file_id", F.lit(17))
    parts = [
        labelled.where(F.col("label") == k).orderBy(order).limit(rows).select("label", "numbers").toPandas() for k in (0, 1)
    ]
    pdf = pd.concat(parts)
    if pdf["label"].nunique() < 2:
        return None
    x = np.array(pdf["numbers"].tolist(), float)
    return Forest.fit(x, pdf["label"].to_numpy().astype(float))


def _scored(numbers: DataFrame, forest: Forest | None) -> DataFrame:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if forest is None or not len(pdf):
                s = np.zeros(len(pdf))
            else:
                s = forest.predict(np.array(pdf["numbers"].tolist(), float).reshape(len(pdf), -1))
            yield pdf[["file_id", "repo_id", "label", "data"]].assign(score=s)

    return numbers.mapInPandas(score, "file_id long, repo_id long, label int, data boolean, score double")


def judged(first: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """Every file of a first pass with file_id, repo_id, label, score and is_foreign, the score against the threshold."""
    numbers = cut(measured(first))
    return _scored(numbers, fit(numbers, rows)).withColumn("is_foreign", F.col("score") >= threshold)


def classify(sources: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """judged() of source texts: file_id, repo_id, content."""
    return judged(first_pass(sources), rows, threshold)


def held_out(sources: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """Per label (and kind of label) files that the forest was not fitted on and how many it gets right.

    Half of the repositories, chosen by a hash, are fitted on, the other half is
    told; a window that a file shares with the other half still counts as shared.
    """
    numbers = cut(measured(first_pass(sources)).where("label >= 0"))
    half = F.pmod(F.xxhash64(F.coalesce("repo_id", F.lit(-1)), F.lit(5)), F.lit(2))
    told = _scored(numbers.where(half == 1), fit(numbers.where(half == 0), rows))
    return told.groupBy("label", "data").agg(
        F.count(F.lit(1)).alias("files"), F.count_if((F.col("score") >= threshold) == (F.col("label") == 1)).alias("right")
    )
