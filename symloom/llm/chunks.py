"""Oversized texts cut into pieces at natural boundaries, with an overlap.

Every place where a text may be cut is a boundary: the end of a function, of a
block, of a line, and within a line longer than the limit its commas, blanks or
characters. A piece that ends at one boundary settles where the next one starts,
set back by the overlap, and that start has one farthest legal end, so each
boundary as an end has one successor. The cuts are what can be reached from the
end of the text's first piece, found by squaring the table: after k rounds the
marked set holds the first 2^k ends. All texts of a batch lie in one table and
are squared together.

The overlap is kept whole wherever it and one more boundary fit into the limit.
Where they do not, the piece shares as many whole lines as leave room for that
boundary; within a line longer than the limit there is no whole line to share.
Of what a piece may add to the shared lines it fills at least the part ``FILL``,
and it ends so late that the piece after it starts later than it did.

Defined cases: a null content gives no piece, an empty one a single empty piece;
a limit that is null or below 4 bytes (one character's most) counts as 4; a null
overlap counts as ``OVERLAP``, a negative one as 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.sources import language_column
from symloom.llm.syntax import functions as fn
from symloom.session import spread

#: Lines shared by neighbours where the options do not say.
OVERLAP = 100
#: Part of the room beyond the shared lines that a piece must fill before a better boundary is preferred to a later one.
FILL = 0.5
#: Bytes of pieces that are handed on at once.
BATCH_BYTES = 32 << 20

CHARACTER, SPLIT, LINE, BLOCK, FUNCTION = range(5)


def boundaries(text: str, language: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code-point offsets of the boundaries, their byte offsets, line numbers and levels.

    No two neighbours are further apart than the limit, in bytes.
    """
    encoded = text.encode("utf-8", "surrogatepass")
    if len(encoded) == len(text):
        byte_at = None
    else:
        points = np.fromiter(map(ord, text), np.int64, len(text))
        byte_at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])

    def to_bytes(at: np.ndarray) -> np.ndarray:
        return at if byte_at is None else byte_at[at]

    ends = np.array([m.end() for m in re.finditer(r"\n", text)] + ([len(text)] if not text.endswith("\n") else []), np.int64)
    offsets = np.concatenate([[0], ends])
    levels = np.full(len(offsets), LINE)
    lines = np.arange(len(offsets))
    starts = offsets[:-1]
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        stripped = text[a:b].strip()
        if not stripped or stripped[0] == "}" or stripped[:2] == "</":
            levels[i + 1] = BLOCK
    for f in fn.functions(text, language) if language else []:
        levels[min(f.end_line, len(levels) - 1)] = FUNCTION
    sizes = np.diff(to_bytes(offsets))
    long = np.flatnonzero(sizes > limit)
    if len(long):
        more_at, more_level, more_line = [], [], []
        for i in long.tolist():
            a, b = int(starts[i]), int(ends[i])
            soft = np.array([m.end() for m in re.finditer(r"[;,{})\]]\s*|\s+", text[a:b])], np.int64) + a
            soft = soft[(soft > a) & (soft < b)]
            marks = np.concatenate([[a], soft, [b]])
            gaps = np.flatnonzero(np.diff(to_bytes(marks)) > limit)
            hard = []
            for g in gaps.tolist():
                at, stop = int(marks[g]), int(marks[g + 1])
                while stop - at > 0 and int(to_bytes(np.array(stop)) - to_bytes(np.array(at))) > limit:
                    if byte_at is None:
                        at += limit
                    else:
                        at = max(at + 1, int(np.searchsorted(byte_at, byte_at[at] + limit, side="right")) - 1)
                    hard.append(at)
            more_at += [*soft.tolist(), *hard]
            more_level += [SPLIT] * len(soft) + [CHARACTER] * len(hard)
            more_line += [i] * (len(soft) + len(hard))
        offsets = np.concatenate([offsets, np.array(more_at, np.int64)])
        levels = np.concatenate([levels, np.array(more_level, np.int64)])
        lines = np.concatenate([lines, np.array(more_line, np.int64)])
        order = np.argsort(offsets, kind="stable")
        offsets, levels, lines = offsets[order], levels[order], lines[order]
        keep = np.concatenate([[True], np.diff(offsets) > 0])
        offsets, levels, lines = offsets[keep], levels[keep], lines[keep]
    return offsets, to_bytes(offsets), lines, levels


def successors(at: np.ndarray, lines: np.ndarray, levels: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each boundary, as the end of a piece, the start and the end of the next piece; and the end of the first.

    The start lies `overlap` whole lines before the end, or as many as leave
    room for one more boundary. The next end is the last boundary within the
    limit, or the last one of the best level where that still fills the room
    well. The last boundary is its own successor.
    """
    n = len(at)
    index = np.arange(n)
    start = index.copy()
    if overlap > 0:
        whole = np.flatnonzero(levels >= LINE)
        place = np.searchsorted(whole, index, side="right") - 1
        # the line that an end lies in counts as the last of the shared ones
        back = np.maximum(place - np.where(whole[place] < index, overlap - 1, overlap), 0)
        need = at[np.minimum(index + 1, n - 1)] - limit
        fits = np.searchsorted(at[whole], need, side="left")
        start = np.minimum(whole[np.minimum(np.maximum(back, fits), len(whole) - 1)], index)
        # no whole line fits beside the next boundary
        start = np.where(at[start] < need, index, start)
        start[0] = 0
    farthest = np.minimum(np.searchsorted(at, at[start] + limit, side="right") - 1, n - 1)
    farthest = np.maximum(farthest, np.minimum(index + 1, n - 1))
    room = limit - (at - at[start])
    enough = np.maximum(np.searchsorted(at, at + (room * FILL).astype(np.int64), side="left"), index + 1)
    # the piece after the next must start later than the next one, or it would hold all of it
    enough = np.maximum(enough, np.searchsorted(np.maximum.accumulate(start), start, side="right"))
    end = farthest.copy()
    done = farthest == n - 1
    for level in (FUNCTION, BLOCK, LINE, SPLIT):
        marked = np.where(levels >= level, index, -1)
        last = np.maximum.accumulate(marked)[farthest]
        better = ~done & (last >= enough)
        end[better] = last[better]
        done |= better
    first = int(end[0])
    end[n - 1] = n - 1
    return start, end, first


def reachable(next_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Boundaries reached from the first ones by the successor table, by squaring it."""
    marked = np.zeros(len(next_), bool)
    marked[first] = True
    table = next_.copy()
    while True:
        more = marked.copy()
        more[table[marked]] = True
        squared = table[table]
        if (squared == table).all() and (more == marked).all():
            return marked
        marked, table = more, squared


_PIECES = "item_id long, piece int, pieces int, start_char int, end_char int, start_line int, end_line int, bytes int, cut_at string, text string"
_LEVELS = np.array(["character", "split", "line", "block", "function"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts, first, base = [], [], 0
        for item, text, language, limit, overlap in zip(
            pdf["item_id"], pdf["text"], pdf["language"], pdf["limit"], pdf["overlap"], strict=True
        ):
            if not isinstance(text, str):
                continue
            limit = max(4, int(limit)) if pd.notna(limit) else 4
            overlap = max(0, int(overlap)) if pd.notna(overlap) else OVERLAP
            if len(text) <= limit and (text.isascii() or len(text.encode("utf-8", "surrogatepass")) <= limit):
                # one piece: only its two ends matter
                size = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
                ends = [0, len(text)] if text else [0]
                offsets, at = np.array(ends), np.array([0, size][: len(ends)])
                lines, levels = np.array([0, text.count("\n") + (not text.endswith("\n"))][: len(ends)]), np.full(len(ends), LINE)
            else:
                offsets, at, lines, levels = boundaries(text, language or "", limit)
            start, next_, end = successors(at, lines, levels, limit, overlap)
            parts.append((item, text, offsets, at, lines, levels, start, next_, base))
            first.append(base + end)
            base += len(offsets)
        if not parts:
            continue
        table = np.concatenate([p[7] + p[8] for p in parts])
        marked = reachable(table, np.array(first))
        out, size = _empty(), 0
        for item, text, offsets, at, lines, levels, start, _, base in parts:
            ends = np.flatnonzero(marked[base : base + len(offsets)])
            starts = np.concatenate([[0], start[ends[:-1]]])
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                out["item_id"].append(item)
                out["piece"].append(k)
                out["pieces"].append(len(ends))
                out["start_char"].append(int(offsets[a]))
                out["end_char"].append(int(offsets[b]))
                out["start_line"].append(int(lines[a]) + 1)
                out["end_line"].append(int(lines[b]) + (1 if levels[b] < LINE else 0))
                out["bytes"].append(int(at[b] - at[a]))
                out["cut_at"].append(_LEVELS[levels[b]])
                out["text"].append(text[offsets[a] : offsets[b]])
                size += out["bytes"][-1]
                if size > BATCH_BYTES:
                    yield pd.DataFrame(out).astype({"item_id": "Int64"})
                    out, size = _empty(), 0
        yield pd.DataFrame(out).astype({"item_id": "Int64"})


def _empty() -> dict[str, list]:
    return {c.split()[0]: [] for c in _PIECES.split(", ")}


def split_items(items: DataFrame) -> DataFrame:
    """Pieces of every item. items: item_id, text, language, limit (bytes), overlap (lines).

    Items within their limit come back as their one piece.
    """
    return spread(
        items.select(
            F.col("item_id").cast("long"),
            F.col("text").cast("string"),
            F.col("language").cast("string"),
            F.col("limit").cast("long"),
            F.col("overlap").cast("long"),
        )
    ).mapInPandas(_cut, _PIECES)


def source_items(sources: DataFrame, options: DataFrame) -> DataFrame:
    """Source texts with the threshold and overlap in force for their repository.

    Options are one row per repository; texts of a repository without options
    have no limit and are left out.
    """
    settings = options.select(
        F.col("repo_id").alias("o_repo"),
        F.col("file_size_policy.chunking_threshold").alias("limit"),
        F.coalesce("chunk_overlap_lines", F.lit(OVERLAP)).alias("overlap"),
    ).where("limit is not null")
    return sources.join(settings, F.col("repo_id") == F.col("o_repo")).select(
        F.col("file_id").alias("item_id"),
        F.col("content").alias("text"),
        language_column("language", "path").alias("language"),
        "limit",
        "overlap",
    )
