"""Personal information in free text: found by the tagger, checked, replaced.

The tagger decodes overlapping windows of every text and reconciles them. An
exact check follows on each span it found: a span is moved to the pattern of its
kind that it touches, and dropped where it cannot be of its kind at all (an
email without a sign or word for at, a number without digits).

Defined cases: null and empty texts hold nothing and come out as they are;
repeated documents give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.tagger import Tagger
from symloom.session import spread

#: Placeholder of each kind.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
_AT = re.compile(r"@|\bat\b|\(at\)|\[at\]|＠", re.I)
_LEFT = {
    "email": re.compile(r"[\w.+-]*$"),
    "phone": re.compile(r"[+(\d][\d ().+-]{0,6}$"),
    "id_number": re.compile(r"[A-Z\d][A-Z\d /-]{0,4}$"),
    "address": re.compile(r"[\wÀ-ÿ'’-]*$"),
    "name": re.compile(r"[^\W\d_]*$"),
}
_RIGHT = {
    "email": re.compile(r"[\w-]*(?:\.[\w-]+)*"),
    "phone": re.compile(r"[\d]*"),
    "id_number": re.compile(r"[A-Z\d]*"),
    "address": re.compile(r"[\wÀ-ÿ'’-]*"),
    "name": re.compile(r"[^\W\d_]*"),
}


def checked(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans with whole words and numbers, without those that cannot be of their kind.

    An email needs a sign or word for at, a telephone number 7 to 15 digits, an
    identity number 4, an address a house number, a name two parts without
    digits. No word and no shape beyond that is asked for.
    """
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if kind in ("email", "address", "name"):
            a -= len(_LEFT[kind].search(text[max(0, a - 40) : a])[0])
        b += len(_RIGHT[kind].match(text, b)[0])
        piece = text[a:b]
        if kind == "email" and piece.lower().startswith("mailto:"):
            a += 7
            piece = text[a:b]
        lead = len(piece) - len(piece.lstrip(" \t\r\n\"'<,;:|"))
        a += lead
        piece = text[a:b].rstrip(" \t\r\n\"'>,;:|")
        b = a + len(piece)
        digits = sum(map(str.isdigit, piece))
        if kind == "email" and (not _AT.search(piece) or piece.lower().startswith("git@")):
            continue
        if kind == "phone" and not 7 <= digits <= 15:
            continue
        if kind == "id_number" and digits < 4:
            continue
        if kind == "address" and not digits:
            continue
        if kind == "name" and (digits or len(piece.replace(",", " ").split()) < 2):
            continue
        if out and a < out[-1][1]:
            continue
        if b > a:
            out.append((a, b, kind))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each span and otherwise unchanged."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def _base(documents: DataFrame) -> DataFrame:
    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _found(texts: list) -> list[list[tuple[int, int, str]]]:
    tagger = Tagger.load()
    known = [t if isinstance(t, str) else "" for t in texts]
    return [checked(t, s) for t, s in zip(known, tagger.spans(known), strict=True)]


def mentions(documents: DataFrame) -> DataFrame:
    """doc_id, kind, start_char, end_char and the text of each mention."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            rows = [
                (doc, kind, a, b, text[a:b])
                for doc, text, spans in zip(pdf["doc_id"], texts, _found(texts), strict=True)
                for a, b, kind in spans
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_char", "end_char", "mention"]).astype({"doc_id": "Int64"})

    return _base(documents).mapInPandas(run, "doc_id long, kind string, start_char long, end_char long, mention string")


def redact(documents: DataFrame) -> DataFrame:
    """doc_id, the text with placeholders, and how many mentions were replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            found = _found(texts)
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "text": [masked(t, s) if isinstance(t, str) else None for t, s in zip(texts, found, strict=True)],
                    "mentions": [len(s) for s in found],
                }
            )

    return _base(documents).mapInPandas(run, "doc_id long, text string, mentions int")
