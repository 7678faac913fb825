"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Weights live in tagger.npz beside this file, made by train_tagger.py. Texts are
cut into overlapping windows of one length; many windows run as one matrix
through both directions, a Viterbi pass per window decodes them, and the spans
of all windows are reconciled: of two that overlap the one further from its
window's edges stands.
"""

from __future__ import annotations

import bisect
import functools
import io
import pkgutil
import unicodedata

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
#: O, then B and I of each kind.
LABELS = 1 + 2 * len(KINDS)
WINDOW = 448
OVERLAP = 72
BATCH = 512

_ASCII = 95
#: Classes of characters beyond ASCII, after the 95 printable ones; 0 pads.
_CLASSES = ("Lu", "Ll", "Lo", "N", "P", "S", "Z", "Cc", "other")
VOCABULARY = 1 + _ASCII + 3 + len(_CLASSES)


@functools.cache
def _table() -> np.ndarray:
    """Ids of the characters of the basic plane."""
    out = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        out[code] = _char_id(chr(code))
    return out


def _char_id(c: str) -> int:
    code = ord(c)
    if 32 <= code < 127:
        return 1 + code - 32
    if c == "\n":
        return 1 + _ASCII
    if c == "\t":
        return 2 + _ASCII
    if c == "\r":
        return 3 + _ASCII
    category = unicodedata.category(c)
    for k, name in enumerate(_CLASSES):
        if category == name or category[0] == name:
            return 4 + _ASCII + k
    return VOCABULARY - 1


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table()[np.minimum(codes, 0xFFFF)]


def legal() -> np.ndarray:
    """Scores that rule out transitions into I from anything but its own B or I."""
    out = np.zeros((LABELS, LABELS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[inside - 1, inside] = out[inside, inside] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def lstm(ids: np.ndarray, table: np.ndarray, recurrent: np.ndarray) -> np.ndarray:
    """Hidden states (time, batch, size) for ids (time, batch); gates are in the order i, f, o, g."""
    steps, batch = ids.shape
    size = recurrent.shape[0]
    hidden = np.zeros((batch, size), np.float32)
    cell = np.zeros((batch, size), np.float32)
    out = np.empty((steps, batch, size), np.float32)
    gates = np.empty((batch, 4 * size), np.float32)
    half = np.float32(0.5)
    for t in range(steps):
        np.dot(hidden, recurrent, out=gates)
        gates += table[ids[t]]
        # sigmoid as tanh of half: one call for all gates
        gates[:, : 3 * size] *= half
        np.tanh(gates, out=gates)
        ifo = gates[:, : 3 * size]
        ifo *= half
        ifo += half
        cell *= gates[:, size : 2 * size]
        cell += gates[:, :size] * gates[:, 3 * size :]
        np.tanh(cell, out=hidden)
        hidden *= gates[:, 2 * size : 3 * size]
        out[t] = hidden
    return out


class Tagger:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, np.float32) for k, v in weights.items() if k != "plain"}

    @staticmethod
    @functools.cache
    def load() -> Tagger:
        data = pkgutil.get_data("symloom.llm", "tagger.npz")
        with np.load(io.BytesIO(data)) as z:
            return Tagger({k: z[k] for k in z.files})

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Label scores (time, batch, labels) of ids (time, batch)."""
        forward = lstm(ids, self.w["table_f"], self.w["recurrent_f"])
        backward = lstm(ids[::-1], self.w["table_b"], self.w["recurrent_b"])[::-1]
        size = forward.shape[2]
        return forward @ self.w["out"][:size] + backward @ self.w["out"][size:] + self.w["bias"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best label sequence (time, batch) by Viterbi."""
        scores = self.emissions(ids)
        steps, batch, _ = scores.shape
        moves = (self.w["transitions"] + legal()).T[None]
        best = scores[0] + self.w["start"]
        back = np.empty((steps, batch, LABELS), np.int8)
        for t in range(1, steps):
            through = best[:, None, :] + moves
            choice = through.argmax(2)
            back[t] = choice
            best = np.take_along_axis(through, choice[:, :, None], 2)[:, :, 0] + scores[t]
        out = np.empty((steps, batch), np.int8)
        out[-1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, rows, out[t]]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text, in order and without overlaps."""
        step = WINDOW - OVERLAP
        owners, starts, rows = [], [], []
        for k, text in enumerate(texts):
            ids = encode(text)
            at = 0
            while at < len(ids):
                row = np.zeros(WINDOW, np.uint8)
                part = ids[at : at + WINDOW]
                row[: len(part)] = part
                owners.append(k)
                starts.append(at)
                rows.append(row)
                if at + WINDOW >= len(ids):
                    break
                at += step
        found: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
        # windows of like length go together, so that little padding is computed
        lengths = np.array([min(WINDOW, len(texts[k]) - at) for k, at in zip(owners, starts, strict=True)], np.int64)
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(rows), BATCH):
            chosen = order[a : a + BATCH]
            width = int(lengths[chosen[0]])
            block = np.stack([rows[x] for x in chosen])
            labels = self.decode(np.ascontiguousarray(block[:, :width].T)).T
            for b in np.flatnonzero((labels > 0).any(1)):
                k, offset = owners[chosen[b]], starts[chosen[b]]
                row = labels[b]
                n = len(texts[k]) - offset
                for s in np.flatnonzero((row % 2 == 1) & (row > 0)):
                    e = s + 1
                    while e < width and row[e] == row[s] + 1:
                        e += 1
                    if s >= n:
                        continue
                    left = s if offset else WINDOW
                    right = WINDOW - e if offset + WINDOW < len(texts[k]) else WINDOW
                    found[k].append((min(left, right), offset + int(s), offset + min(int(e), n), KINDS[(row[s] - 1) // 2]))
        return [_reconcile(x) for x in found]


def _reconcile(spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans keep the one furthest from the edges of its window."""
    taken: list[tuple[int, int, str]] = []
    for _, a, b, kind in sorted(spans, key=lambda x: (-x[0], x[1], x[2])):
        i = bisect.bisect_left(taken, (a, b, kind))
        if (i < len(taken) and taken[i][0] < b) or (i and taken[i - 1][1] > a):
            continue
        taken.insert(i, (a, b, kind))
    return taken
