"""Training of the tagger: labelled spans from texts, gradients in numpy, Adam.

    OMP_NUM_THREADS=1 python -m symloom.llm.train_tagger FOLDER

The stored weights come from that command with no further options and FOLDER =
sf0.1, from random weights on; README.md has their accuracy.

Labels are weak: patterns for addresses of all kinds and numbers, and for names
the given and family names of the contributors table, completed by family names
seen beside a known given name. In part of the windows names are replaced by
invented ones and the case of names changes, so that the model learns from what
stands around a name as well as from the name. To the windows of the texts come
invented sentences of other forms, with names, streets and numbers made up from
syllables and with capitalised words that name nobody (``invented``), and
windows of the texts with such names and words set between any two words
(``placed``), so that a name is also told where nothing around it speaks of one.
"""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np

from symloom.llm.tagger import KINDS, LABELS, VOCABULARY, encode, sigmoid

SIZE = 48
LENGTH = 144
DOMAIN = r"(?:[\w-]+(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?| dot ))+[A-Za-z]{2,}"
EMAIL = re.compile(rf"(?<![\w@/.+-])(?!git@)[\w.+-]*[\w+]\s?(?:@|\s?\(at\)\s?|\s?\[at\]\s?)\s?{DOMAIN}(?![\w:/])|(?<![\w@/.+-])[\w.+-]*[\w+] at (?:[\w-]+ dot )+[a-z]{{2,}}\b", re.I)
PHONE = re.compile(
    r"(?<![\w.+#/-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{3,4}){1,3}|00\d{2}[ .-]?\d{2,5}[ .-]?\d{4,6}(?:[ .-]?\d{3,4})?|1-\d{3}-\d{3}-\d{4}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4} \d{3,4} ?\d{3,4}(?: \d{3,4})?)(?![\w-]|[.,]\d)"
)
ID = re.compile(
    r"\b(?:passport no\.?|passport number|id card(?: no\.?)?|SSN|social security number:?|tax id|driving licen[cs]e|personnel number|Ausweisnr\.?|Personalnr\.?|Steuer-?ID|num[ée]ro de s[ée]curit[ée] sociale)[: ]\s?([A-Z]{0,3}\d[\dA-Z]*(?:[ /-]\d[\dA-Z]*)*)",
    re.I,
)
_STREET = r"(?:[A-ZÀ-Þ][\w'’-]*\s){1,3}(?:(?:Street|Lane|Road|Way|Avenue|Drive|Court|Row|Close|Terrace|Place|Square|Hill|Walk|Gardens)\b|(?:St|Ln|Rd|Ave|Dr|Ct)\b\.?)"
_PLACE = r"(?:,?\s(?:Apt|Flat|Unit|Suite)\s\w+)?(?:,\s[A-ZÀ-Þ][\w'’-]+(?:\s\d{5})?|,\s\d{5}\s[A-ZÀ-Þ][\w'’-]+)?"
ADDRESS = re.compile(
    rf"\b(?:\d{{1,4}}[A-Za-z]?\s{_STREET}{_PLACE}|\d{{1,4}}[A-Za-z]?,?\s(?:rue|avenue|allée|place|chemin|quai|boulevard|impasse|cours|route|passage|sentier|square)\s(?:de la |des |du |de |d')?[A-ZÀ-Þ][\w'’-]+(?:-[\w'’]+)*{_PLACE}|(?:(?:Am|An der|Im|Zum|Zur|Auf dem|Unter den)\s(?:[A-ZÀ-Þ][\w-]+\s?){{1,2}}|[A-ZÀ-Þ][\wßäöü-]*(?:str\.|straße|strasse|gasse|weg|platz|allee|ring|damm))\s\d{{1,4}}[A-Za-z]?{_PLACE})"
)


class Labeller:
    def __init__(self, given: set[str], family: set[str]):
        g = "|".join(sorted(map(re.escape, given), key=len, reverse=True))
        f = "|".join(sorted(map(re.escape, family), key=len, reverse=True))
        self.given, self.family = given, family
        self.names = re.compile(
            rf"(?<![\w.@/+-])(?:(?:{g})\s+(?:[A-Za-z]\.\s*)?(?:{f})|(?:{f}),?\s+(?:{g})(?:\s[A-Z]\.)?|[A-Z]\.\s?(?:[A-Z]\.\s?)?(?:{f})|(?:{f}),\s[A-Z]\.(?!\w))(?![\w@-]|\.\w)", re.I
        )

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
        out += [(m.start(1), m.end(1), "id_number") for m in ID.finditer(text)]
        out += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(text)]
        out += [(m.start(), m.end(), "name") for m in self.names.finditer(text)]
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text)]
        kept: list[tuple[int, int, str]] = []
        for a, b, k in out:
            if not any(a < y and x < b for x, y, _ in kept):
                kept.append((a, b, k))
        return sorted(kept)


_ONSETS = "b br c ch d dr f fr g gr h j k kh kr l m n p pr r s sch sh st t th tr v w y z".split() + [""]
_VOWELS = "a a a e e e i i o o u ai ei ia ou y á é ö ü".split()
_CODAS = "n l r s m k t nd rt lt ss ck ng sz z".split() + [""] * 12


def _pseudonym(rng: random.Random) -> str:
    if rng.random() < 0.5:
        return "".join(rng.choice(_ONSETS) + rng.choice(_VOWELS) + rng.choice(_CODAS) for _ in range(rng.choice((2, 2, 2, 3)))).capitalize()
    parts = "ba bel bro cal cor dan dor el fen gar hal hol is jor kal kes lan lin mar mo nel nor ol per quin ran ros sel sor tan tor ul val ver wen wil xan yor zel".split()
    ends = "a e o an en is ik us in ow er ell ard ine ette ström berg wood ford worth vig by son mann eck".split()
    return ("".join(rng.choice(parts) for _ in range(rng.choice((1, 1, 2)))) + rng.choice(ends)).capitalize()


_FORMS = """
Contact {name} at the desk|Please call {name} before noon.|{name} will join on Monday|Ask {name} or {name} for the key.|Sent by {name}, {phone}|cc {name} <{email}>|Regards,\n{name}|- {name}: done
I met {name} yesterday and we agreed to wait.|The report of {name} is late, says {name}.|"{name}" signed the form on page 3|Dear {name},\nthank you for the parcel.|owner: {name}|Author: {name} <{email}>
{name} lives at {street}.|Ship it to {street}, please.|Our office moved to {street}|Deliver to {name}, {street}.|address: {street}|The van stops at {street} at nine.|{street} is closed on Sundays|invoice for {name}\n{street}
Reach me under {phone} or {email}.|phone: {phone}|Tel. {phone}|Mobile {phone}, ask for {name}|Call {phone} after six|mail {email} and wait|write to {email}|{email} bounced twice
passport {id} of {name}|ID card {id} was scanned|tax number {id} is missing|Her licence number {id} expired.|employee no. {id}|SSN: {id}|insurance number {id} of {name} does not match
Bitte {name} anrufen.|Gruß, {name}|Frau {name} wohnt in der {street}.|Lieferung an {name}, {street}|Rückfragen an {email} oder {phone}|Ausweis {id} liegt bei|Herr {name} kommt um acht.
Merci de rappeler {name} au {phone}.|{name} habite {street}.|Envoyer à {street} avant lundi|Cordialement, {name}|dossier {id} de {name}|écrire à {email}
The {Word} {Word} screen is slow|{Word} {Word} is the name of the worker|We moved the {Word} {Word} to the {Word} board.|release {Word} {number}.{number}.{number} is out|At most {number} {Word} {Word} are open|Row {number}-{number}-{number} of the {word} export
{Word} {word} {word} and {word}.|Each of the {number} {word} carries a {word} between {number} and {number}.|{WORD} {WORD} AT MOST {number} {WORD}|between {number} and {number} {word}|Every {word} {word} {word} {number}.|no {word} {word} has more than {number} {word}
#{number} {Word} {word}|{word}: {word} {word}|Thanks to the {word} {word} team|build {number} took {number} s|see {Word}/{Word} or {Word} {Word}, whichever is newer|No two {word} {word} share a {word}|{number} {word} and {number} {word}|port {number}, id {number}-{number}
"""
_ROADS = ("Street Lane Road Way Avenue Drive Court Row Close Terrace Place Square Hill Walk Gardens Crescent Parade Grove Mews Boulevard St Rd Ave Dr".split(), "straße str. gasse weg platz allee ring damm ufer stieg".split(), "rue,avenue,allée,place,chemin,quai,boulevard,impasse,rue de la,rue du,avenue de,chemin des".split(","))
_GROWING = "Oak Mill Church Fern Station High Garden River Park Bridge Maple School Market King Queen Castle Meadow Harbour Linden Rat Bahnhof Kirch Berg Wald Blumen".split()


def _person(rng: random.Random) -> str:
    given, family = _pseudonym(rng), _pseudonym(rng)
    if rng.random() < 0.1:
        given = f"{given}-{_pseudonym(rng)}"
    if rng.random() < 0.2:
        family = rng.choice(_GROWING) if rng.random() < 0.5 else f"{rng.choice(('van', 'de', 'von', 'Mac', 'O’', 'di'))} {family}".replace("’ ", "’")
    initial = rng.choice("ABCDEFGHIJKLMNOPRSTVW")
    form = rng.random()
    name = (
        f"{given} {family}" if form < 0.62 else f"{given} {initial}. {family}" if form < 0.7 else f"{initial}. {family}" if form < 0.78 else f"{family}, {given}" if form < 0.86 else f"{given} {_pseudonym(rng)} {family}" if form < 0.95 else f"{family}, {initial}."
    )
    style = rng.random()
    return name.lower() if style < 0.08 else name.upper() if style < 0.14 else name


def _place(rng: random.Random) -> str:
    stem = rng.choice(_GROWING) if rng.random() < 0.5 else _pseudonym(rng)
    number = f"{rng.randrange(1, 400)}{rng.choice(['', '', '', 'a', 'b'])}"
    kind = rng.randrange(3)
    if kind == 0:
        out = f"{number} {stem} {rng.choice(_ROADS[0])}"
    elif kind == 1:
        out = f"{stem}{rng.choice(_ROADS[1])} {number}" if rng.random() < 0.8 else f"{number} {stem}{rng.choice(_ROADS[1])}"
    else:
        out = f"{number}{rng.choice([',', ''])} {rng.choice(_ROADS[2])} {stem}"
    city = _pseudonym(rng) if rng.random() < 0.7 else rng.choice(("Linz", "Oslo", "Leeds", "Lyon", "Bonn", "York"))
    return out + rng.choice(["", "", f", {city}", f", {rng.randrange(10000, 99999)} {city}", f", {city} {rng.randrange(10000, 99999)}"])


def _digits(rng: random.Random, shape: str) -> str:
    return "".join(str(rng.randrange(1, 10)) if c == "9" else str(rng.randrange(10)) if c == "0" else chr(rng.randrange(65, 91)) if c == "A" else c for c in shape)


def invented(words: list[str], rng: random.Random, n: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up windows with their spans; words are common words that name nobody."""
    forms = [f for line in _FORMS.strip().split("\n") for f in line.split("|")]

    def filled(slot: str) -> str:
        word = rng.choice(words)
        return {
            "name": lambda: _person(rng), "street": lambda: _place(rng), "word": lambda: word, "Word": lambda: word.capitalize(), "WORD": lambda: word.upper(), "number": lambda: str(rng.randrange(1, 10 ** rng.randrange(1, 5))),
            "phone": lambda: _digits(rng, rng.choice(("+99 000 000 0000", "+99-00-0000000", "(000) 000-0000", "999-000-0000", "09000 000000", "+990000000000", "0900/0000000", "099 000 00 00"))),
            "email": lambda: f"{_pseudonym(rng)}{rng.choice(['.', '_', '-', ''])}{_pseudonym(rng)}".lower().encode("ascii", "ignore").decode() + rng.choice(["@", "@", "@", " at ", " (at) "]) + rng.choice(["mail.example.org", "corp.example.net", "post.example.com"]),
            "id": lambda: _digits(rng, rng.choice(("A0000000", "000-00-0000", "AA000000A", "00 000 000 000", "A00-0000-0000", "0000000000"))),
        }[slot]()

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < LENGTH - 20 and (not text or rng.random() < 0.7):
            if text:
                text += rng.choice([" ", "\n", "\n\n", ". "])
            for part in re.split(r"(\{\w+\})", rng.choice(forms)):
                if part[:1] == "{":
                    value = filled(part[1:-1])
                    if part[1:-1] in ("name", "street", "phone", "email", "id"):
                        kind = {"street": "address", "id": "id_number"}.get(part[1:-1], part[1:-1])
                        spans.append((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += part
        # a span that the edge would cut ends the window
        end = min([a for a, b, _ in spans if b > LENGTH] + [LENGTH, len(text)])
        out.append((text[:end], [x for x in spans if x[1] <= end]))
    return out


def placed(texts: list[str], words: list[str], labeller: Labeller, rng: random.Random, n: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Windows of texts with invented names, or capitalised words that name nobody, set between two of their words."""
    out = []
    while len(out) < n:
        text = rng.choice(texts)
        start = rng.randrange(max(1, len(text) - 60))
        piece = text[start : start + LENGTH - 30]
        if labeller.spans(text[max(0, start - 40) : start + LENGTH]):
            continue
        gaps = [m.end() for m in re.finditer(r"(?<=\w)[ \n]|(?<=[.:,;!?\n]) |\n|\A", piece)]
        if not gaps:
            continue
        at = rng.choice(gaps)
        name = rng.random() < 0.65
        value = _person(rng) if name else " ".join(rng.choice(words).capitalize() for _ in range(rng.choice((2, 2, 3))))
        follows = rng.choice([" ", " ", " ", ", ", ": ", "\n", ". ", " and "])
        out.append((piece[:at] + value + follows + piece[at:], [(at, at + len(value), "name")] if name else []))
    return [(text[:LENGTH], spans) for text, spans in out if not spans or spans[0][1] <= LENGTH]


def _vary(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """Replace names by invented ones and change their case, moving the spans along."""
    out, new, at = [], [], 0
    length = 0
    for a, b, kind in spans:
        out.append(text[at:a])
        length += a - at
        piece = text[a:b]
        if kind == "name":
            if rng.random() < 0.5:
                piece = re.sub(r"[^\W\d_]{3,}", lambda m: _cased(_pseudonym(rng), m[0]), piece)
            style = rng.random()
            if style < 0.1:
                piece = piece.lower()
            elif style < 0.2:
                piece = piece.upper()
        elif kind in ("phone", "id_number"):
            piece = re.sub(r"\d", lambda m: str(rng.randrange(10)) if rng.random() < 0.5 else m[0], piece)
        new.append((length, length + len(piece), kind))
        out.append(piece)
        length += len(piece)
        at = b
    out.append(text[at:])
    return "".join(out), new


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() else word.lower() if like.islower() else word


def windows(texts: list[str], labeller: Labeller, rng: random.Random, plain: float) -> list[tuple[str, list[tuple[int, int, str]]]]:
    out = []
    for text in texts:
        spans = labeller.spans(text)
        used = -1
        for a, _, _ in spans:
            if a < used:
                continue
            start = max(0, a - rng.randrange(8, LENGTH - 40))
            end = min(len(text), start + LENGTH)
            inside = [(x - start, y - start, k) for x, y, k in spans if x >= start and y <= end]
            # no window edge within a span
            for x, y, _ in spans:
                if x < start < y:
                    start = y
                if x < end < y:
                    end = x
            inside = [(x - start, y - start, k) for x, y, k in spans if x >= start and y <= end]
            out.append((text[start:end], inside))
            used = end
        for _ in range(int(plain) + (rng.random() < plain % 1) if len(text) > 20 else 0):
            start = rng.randrange(max(1, len(text) - 100))
            end = min(len(text), start + LENGTH)
            for x, y, _ in spans:
                if x < start < y:
                    start = y
                if x < end < y:
                    end = x
            out.append((text[start:end], [(x - start, y - start, k) for x, y, k in spans if x >= start and y <= end]))
    return out


def tensors(batch, rng: random.Random, vary: bool) -> tuple[np.ndarray, np.ndarray]:
    ids = np.zeros((LENGTH, len(batch)), np.int64)
    tags = np.zeros((LENGTH, len(batch)), np.int64)
    for j, (text, spans) in enumerate(batch):
        if vary and rng.random() < 0.7:
            text, spans = _vary(text, spans, rng)
        e = encode(text)[:LENGTH]
        ids[: len(e), j] = e
        for a, b, kind in spans:
            k = 1 + 2 * KINDS.index(kind)
            tags[a : min(b, LENGTH), j] = k + 1
            if a < LENGTH:
                tags[a, j] = k
    return ids, tags


class Model:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        n = SIZE
        self.w = {
            "table_f": r.normal(0, 0.1, (VOCABULARY, 4 * n)),
            "table_b": r.normal(0, 0.1, (VOCABULARY, 4 * n)),
            "recurrent_f": r.normal(0, 1 / np.sqrt(n), (n, 4 * n)),
            "recurrent_b": r.normal(0, 1 / np.sqrt(n), (n, 4 * n)),
            "out": r.normal(0, 0.1, (2 * n, LABELS)),
            "bias": np.zeros(LABELS),
            "start": np.zeros(LABELS),
            "transitions": np.zeros((LABELS, LABELS)),
        }
        for d in "fb":
            self.w[f"table_{d}"][:, n : 2 * n] += 1
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.steps = 0

    def _forward(self, ids, d):
        table, u = self.w[f"table_{d}"], self.w[f"recurrent_{d}"]
        steps, batch = ids.shape
        n = SIZE
        h = np.zeros((steps + 1, batch, n), np.float32)
        c = np.zeros((steps + 1, batch, n), np.float32)
        gates = np.empty((steps, batch, 4 * n), np.float32)
        for t in range(steps):
            a = table[ids[t]] + h[t] @ u
            a[:, : 3 * n] = sigmoid(a[:, : 3 * n])
            a[:, 3 * n :] = np.tanh(a[:, 3 * n :])
            gates[t] = a
            c[t + 1] = a[:, n : 2 * n] * c[t] + a[:, :n] * a[:, 3 * n :]
            h[t + 1] = a[:, 2 * n : 3 * n] * np.tanh(c[t + 1])
        return h, c, gates

    def _backward(self, ids, d, state, dh_out, grads):
        h, c, gates = state
        u = self.w[f"recurrent_{d}"]
        steps, batch = ids.shape
        n = SIZE
        dh = np.zeros((batch, n), np.float32)
        dc = np.zeros((batch, n), np.float32)
        da_all = np.empty((steps, batch, 4 * n), np.float32)
        for t in range(steps - 1, -1, -1):
            g = gates[t]
            i, f, o, k = g[:, :n], g[:, n : 2 * n], g[:, 2 * n : 3 * n], g[:, 3 * n :]
            tc = np.tanh(c[t + 1])
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = da_all[t]
            da[:, :n] = dc * k * i * (1 - i)
            da[:, n : 2 * n] = dc * c[t] * f * (1 - f)
            da[:, 2 * n : 3 * n] = dh * tc * o * (1 - o)
            da[:, 3 * n :] = dc * i * (1 - k * k)
            dc = dc * f
            dh = da @ u.T
        flat = da_all.reshape(-1, 4 * n)
        grads[f"recurrent_{d}"] = h[:-1].reshape(-1, n).T @ flat
        table = np.zeros_like(self.w[f"table_{d}"])
        np.add.at(table, ids.reshape(-1), flat)
        grads[f"table_{d}"] = table

    def step(self, ids, tags, rate):
        forward = self._forward(ids, "f")
        backward = self._forward(ids[::-1], "b")
        hf, hb = forward[0][1:], backward[0][1:][::-1]
        both = np.concatenate([hf, hb], 2)
        scores = both @ self.w["out"] + self.w["bias"]
        loss, ds, dtrans, dstart = crf(scores, tags, ids > 0, self.w["transitions"], self.w["start"])
        grads = {"transitions": dtrans, "start": dstart, "bias": ds.sum((0, 1)), "out": both.reshape(-1, 2 * SIZE).T @ ds.reshape(-1, LABELS)}
        dboth = ds @ self.w["out"].T
        self._backward(ids, "f", forward, dboth[:, :, :SIZE], grads)
        self._backward(ids[::-1], "b", backward, np.ascontiguousarray(dboth[::-1, :, SIZE:]), grads)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        self.steps += 1
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
            mh, sh = self.m[k] / (1 - 0.9**self.steps), self.s[k] / (1 - 0.999**self.steps)
            self.w[k] -= (rate * mh / (np.sqrt(sh) + 1e-8)).astype(np.float32)
        return loss


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf(scores, tags, mask, trans, start):
    """Negative log likelihood per window and its gradients; padding is at the end and tagged O."""
    steps, batch, k = scores.shape
    alpha = np.empty_like(scores)
    alpha[0] = scores[0] + start
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans[None], 1) + scores[t]
    z = _lse(alpha[-1], 1)
    beta = np.zeros_like(scores)
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    marginal = np.exp(alpha + beta - z[None, :, None])
    rows = np.arange(batch)
    gold = start[tags[0]] + scores[0, rows, tags[0]]
    dtrans = np.zeros_like(trans)
    for t in range(1, steps):
        gold = gold + trans[tags[t - 1], tags[t]] + scores[t, rows, tags[t]]
        pair = np.exp(alpha[t - 1][:, :, None] + trans[None] + (scores[t] + beta[t])[:, None, :] - z[:, None, None])
        dtrans += pair.sum(0)
        np.add.at(dtrans, (tags[t - 1], tags[t]), -1)
    ds = marginal
    ds[np.arange(steps)[:, None], rows[None], tags] -= 1
    dstart = ds[0].sum(0)
    return float((z - gold).mean()), (ds / batch).astype(np.float32), (dtrans / batch).astype(np.float32), (dstart / batch).astype(np.float32)


def vocabulary(texts: list[str], full_names: list[str]) -> tuple[set[str], set[str]]:
    given = {n.split()[0] for n in full_names if len(n.split()) > 1}
    family = {n.split()[-1] for n in full_names if len(n.split()) > 1}
    more: Counter = Counter()
    g = "|".join(map(re.escape, given))
    near = re.compile(rf"\b(?:{g})\s(?:[A-Z]\.\s)?([A-ZÀ-Þ][a-zà-ÿ]+)\b")
    for text in texts:
        for m in near.finditer(text):
            more[m[1]] += 1
    common = {w for t in texts[:2000] for w in re.findall(r"\b[a-z]{3,}\b", t)}
    family |= {w for w, n in more.items() if n >= 3 and w.lower() not in common and w not in given}
    return given, family


def common_words(texts: list[str], labeller: Labeller, least: int = 20) -> list[str]:
    """Words in small letters that stand outside all spans at least so often."""
    seen: Counter = Counter()
    for text in texts:
        rest, at = [], 0
        for a, b, _ in labeller.spans(text):
            rest.append(text[at:a])
            at = b
        rest.append(text[at:])
        seen.update(re.findall(r"(?<![\w@.+-])[a-zà-ÿ]{3,}(?![\w@+-]|\.\w)", " ".join(rest)))
    return sorted(w for w, n in seen.items() if n >= least)


def main(folder: str, epochs: int = 11, plain: float = 1.0, made: float = 0.8, top: float = 0.01) -> None:
    import pyarrow.parquet as pq

    rng = random.Random(11)
    texts = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    names = [n for n in pq.read_table(f"{folder}/contributors.parquet", columns=["full_name"])["full_name"].to_pylist() if n]
    labeller = Labeller(*vocabulary(texts, names))
    rng.shuffle(texts)
    held, texts = texts[: len(texts) // 10], texts[len(texts) // 10 :]
    data = windows(texts, labeller, rng, plain)
    test = windows(held, labeller, rng, 0.5)
    print(len(data), "windows,", len(test), "held out", flush=True)
    words = common_words(texts, labeller)
    own = len(data)
    apart = invented(words, random.Random(12), 300) + placed(held, words, labeller, random.Random(13), 300)
    model = Model()
    size = 96
    began = time.time()
    total = epochs * (int(own * (1 + made)) // size)
    texts_windows = data
    for epoch in range(epochs):
        data = texts_windows + invented(words, rng, int(own * made / 2)) + placed(texts, words, labeller, rng, int(own * made / 2))
        rng.shuffle(data)
        losses = []
        for a in range(0, len(data) - size + 1, size):
            rate = top * (1 - model.steps / total) + 0.0003
            losses.append(model.step(*tensors(data[a : a + size], rng, True), rate))
        np.savez_compressed(Path(__file__).with_name("tagger.npz"), **{k: v.astype(np.float16) for k, v in model.w.items()})
        print(epoch, round(float(np.mean(losses)), 4), "held out", score(model, test[:600]), "invented", score(model, apart), round(time.time() - began), "s", flush=True)


def score(model: Model, test) -> dict:
    from symloom.llm.tagger import Tagger

    tagger = Tagger(model.w)
    got = tagger.spans([t for t, _ in test])
    hit: Counter = Counter()
    for (_, gold), mine in zip(test, got, strict=True):
        a, b = {(x, k) for x, _, k in gold}, {(x, k) for x, _, k in mine}
        for _, k in a & b:
            hit[k, "tp"] += 1
        for _, k in a - b:
            hit[k, "fn"] += 1
        for _, k in b - a:
            hit[k, "fp"] += 1
    return {k: (hit[k, "tp"], hit[k, "fn"], hit[k, "fp"]) for k in KINDS}


if __name__ == "__main__":
    import argparse

    options = argparse.ArgumentParser()
    options.add_argument("folder")
    options.add_argument("--epochs", type=int, default=11)
    options.add_argument("--plain", type=float, default=1.0, help="windows without a required mention, per text")
    options.add_argument("--made", type=float, default=0.8, help="invented windows, as a share of those of the texts")
    options.add_argument("--top", type=float, default=0.01, help="learning rate at the start")
    given = options.parse_args()
    main(given.folder, given.epochs, given.plain, given.made, given.top)
