"""Evaluation texts inside a corpus, found by Wu-Manber multi-pattern search.

Items and documents are reduced to lower-case words with one blank between
them, without line prefixes. The test strings are the runs of ``RUN`` words of
all items. The search looks at the last ``BLOCK`` characters of a frame as long
as the shortest test string: a shift table says how far the frame may move
where no test string can end, and where it may not move, the bucket of the
frame's end names the strings to compare directly. A document in which the
strings of an item stand unbroken for ``LONG`` words is then compared with that
item word by word: runs found in the same order, with few words between them,
form a chain, and chains that hold such a stretch and are close to each other a
passage. A passage covers ``WORDS`` words of the item at least, words replaced or
left out within a chain included; either its long stretches alone come to that
many, or a chain of that size has no more than one word in ``WORDS`` changed.
Sentences that merely share a form with an item have shorter stretches. No item
is judged by what other items hold, so two items that share a passage are both
found, and it does not matter which items are searched for together.

Defined cases: null or wordless texts hold nothing and leak nothing; items with
equal texts are found together, as runs are told apart by text, not by item;
repeated documents give repeated results; an empty items table finds nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.session import spread

#: Words of a test string.
RUN = 3
#: Words of the item that a passage covers at least.
WORDS = 12
#: Words between two runs of one chain, in the item and in the document.
GAP = 4
#: Words that stand unbroken in each chain of a passage.
LONG = 6
#: Words of the document between two chains of one passage.
BREAK = 16
#: Characters of a block of the shift table.
BLOCK = 4
#: Runs of an item that stand in a document with a passage of it: one word of ``WORDS`` changed leaves so many.
LEAST = WORDS - 1 - 2 * (RUN - 1)
#: Items that are searched for at once; more are searched for in turns.
ITEMS = 20_000

_PREFIX = re.compile(
    r"^[ \t]*(?:(?:>|\||\+|-|\*|#+|//+|/\*+|--|;|%|•|–)[ \t]*)*(?:\[\d{1,2}:\d{2}(?::\d{2})?\][ \t]*(?:<[^>\n]{1,40}>[ \t]*)?|\d{1,5}[:.)|][ \t]+)?(?:(?:>|\||\+|-|\*|//)[ \t]*)*", re.M
)
_JOINERS = re.compile("[­​-‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _JOINERS.sub("", text))
    return _WORD.findall(_PREFIX.sub("", text).casefold())


class Matcher(NamedTuple):
    """Tables of the search; all in plain containers, to be sent to tasks."""

    length: int
    shift: dict[str, int]
    buckets: dict[str, list[str]]
    places: dict[str, list[tuple[int, int]]]
    items: list[int]


def build(items: list[tuple[int, str]]) -> Matcher | None:
    """Tables for the test strings of the items."""
    ids, texts = [], []
    at: dict[str, int] = {}
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for item, text in items:
        w = words(text or "")
        key = " ".join(w)
        if len(w) < RUN or key in at:
            continue
        k = at[key] = len(ids)
        ids.append(item)
        texts.append(key)
        for i in range(len(w) - RUN + 1):
            places[f" {' '.join(w[i : i + RUN])} "].append((k, i))
    if not places:
        return None
    length = min(map(len, places))
    block = min(BLOCK, length)
    shift: dict[str, int] = {}
    buckets: dict[str, list[str]] = defaultdict(list)
    for p in places:
        # the frame is compared with the end of the string, the part it may move over
        tail = p[-length:]
        for j in range(block, length + 1):
            b = tail[j - block : j]
            shift[b] = min(shift.get(b, length), length - j)
        buckets[tail[-block:]].append(p)
    return Matcher(length, shift, dict(buckets), dict(places), ids)


def search(matcher: Matcher, text: str) -> list[tuple[int, str]]:
    """All occurrences of test strings as (offset, string); text has blanks at both ends."""
    length, shift, buckets = matcher.length, matcher.shift, matcher.buckets
    block = min(BLOCK, length)
    jump = length - block + 1
    out = []
    end, n = length, len(text)
    get = shift.get
    while end <= n:
        b = text[end - block : end]
        s = get(b, jump)
        if s:
            end += s
            continue
        for p in buckets.get(b, ()):
            if text.startswith(p, end - len(p)) and end >= len(p):
                out.append((end - len(p), p))
        end += 1
    return out


def passages(matcher: Matcher, text: str) -> list[tuple[int, int, int, int]]:
    """Passages as (item index, words of the item, first word, last word in the document)."""
    w = words(text)
    if len(w) < RUN:
        return []
    joined = f" {' '.join(w)} "
    hits = search(matcher, joined)
    if len(hits) <= LONG - RUN:
        return []
    # word number of each offset that begins with a blank
    number, at = {}, 0
    for i, x in enumerate(w):
        number[at] = i
        at += len(x) + 1
    runs: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for offset, p in hits:
        d = number[offset]
        for item, i in matcher.places[p]:
            runs[item].add((d, i))
    out = []
    for item, found in runs.items():
        if len(found) < LEAST or not any(all((d + k, i + k) in found for k in range(1, LONG - RUN + 1)) for d, i in found):
            continue
        chains = [c for c in _chains(sorted(found)) if c.long]
        chains.sort(key=lambda c: (c.first, c.last))
        start = 0
        while start < len(chains):
            stop = start + 1
            last = chains[start].last
            while stop < len(chains) and chains[stop].first - last <= BREAK:
                last = max(last, chains[stop].last)
                stop += 1
            group = chains[start:stop]
            covered: set[int] = set()
            for c in group:
                covered.update(range(c.a, c.b + 1))
            if len(covered) >= WORDS and (sum(c.long for c in group) >= WORDS or any(c.nearly_whole() for c in group)):
                out.append((item, len(covered), chains[start].first, last))
            start = stop
    return out


class _Chain:
    """Runs in order: first and last word in the document, a and b in the item, words that are equal and in long stretches."""

    __slots__ = ("a", "b", "at", "equal", "first", "last", "long", "unbroken")

    def __init__(self, d: int, i: int):
        self.first, self.last, self.a, self.b = d, d + RUN - 1, i, i + RUN - 1
        self.at = (d, i)
        self.equal = self.unbroken = RUN
        self.long = 0

    def add(self, d: int, i: int) -> None:
        self.equal += min(RUN, d + RUN - 1 - self.last)
        self.unbroken = self.unbroken + 1 if self.at == (d - 1, i - 1) else RUN
        if self.unbroken >= LONG:
            self.long += LONG if self.unbroken == LONG else 1
        self.last, self.b = d + RUN - 1, max(self.b, i + RUN - 1)
        self.at = (d, i)

    def nearly_whole(self) -> bool:
        size = max(self.last - self.first, self.b - self.a) + 1
        return self.b - self.a + 1 >= WORDS and (size - self.equal) * WORDS <= size


def _chains(found: list[tuple[int, int]]) -> list[_Chain]:
    """Runs (word of the document, word of the item), sorted, joined in order."""
    chains: list[_Chain] = []
    open_: list[_Chain] = []
    for d, i in found:
        open_ = [c for c in open_ if d - c.last <= GAP]
        best = None
        for c in open_:
            step, forward = d - c.last, i - c.b
            if forward <= GAP and i + RUN - 1 > c.b and d + RUN - 1 > c.last and (step > 0) == (forward > 0) and (best is None or abs(step - forward) < abs((d - best.last) - (i - best.b))):
                best = c
        if best is None:
            best = _Chain(d, i)
            chains.append(best)
            open_.append(best)
        else:
            best.add(d, i)
    return chains


_FOUND = "doc_id long, item_id long, words int, first_word int, last_word int"


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Passages of items in documents: doc_id, item_id, words, first_word, last_word.

    documents: doc_id, text. items: item_id, item_text. The items are brought to
    the tasks in turns of at most ``ITEMS``; every document is searched in full.
    """
    wanted = items.where("item_id is not null and item_text is not null").select(
        F.col("item_id").cast("long"), F.col("item_text").cast("string")
    )
    turns = max(1, -(-wanted.count() // ITEMS))
    base = spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), 3)
    out = None
    for turn in range(turns):
        rows = wanted.where(F.pmod(F.xxhash64("item_text"), F.lit(turns)) == turn).collect()
        by_text: dict[str, list[int]] = defaultdict(list)
        first: dict[str, int] = {}
        for item, text in sorted(map(tuple, rows)):
            key = " ".join(words(text))
            first.setdefault(key, item)
            by_text[key].append(item)
        same = {first[k]: v for k, v in by_text.items()}
        matcher = build([(first[k], k) for k in first])
        part = _search(base, matcher, same)
        out = part if out is None else out.unionByName(part)
    return out


def _search(base: DataFrame, matcher: Matcher | None, same: dict[int, list[int]]) -> DataFrame:
    sent = base.sparkSession.sparkContext.broadcast((matcher, same))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, twins = sent.value
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if m is not None and isinstance(text, str):
                    for item, n, a, b in passages(m, text):
                        rows += [(doc, twin, n, a, b) for twin in twins[m.items[item]]]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "first_word", "last_word"]).astype(
                {"doc_id": "Int64", "item_id": "int64"}
            )

    return base.mapInPandas(run, _FOUND)
