"""Shared parts of the recursive-descent recognisers.

A lexer turns a text into parallel arrays (kind, value, offset, newline flag,
matching bracket) closed by an end token; a parser walks them with one index,
so looking ahead and stepping back cost nothing. A failure raises
``SyntaxFailure``; the statement loops catch it, keep it in ``errors`` and
resume at the next likely statement start (panic mode), so one file yields all
of its errors with the first one as the cause. Nesting is followed however deep
it goes: calls between the rules take room on the heap, not on the C stack, and
the interpreter's own limit is lifted while a text is parsed (``deep``).
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

NAME, PRIVATE, NUMBER, STRING, TEMPLATE, HEAD, MIDDLE, TAIL, REGEX, PUNCT, END, ELEMENT = range(1, 13)

OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {")": "(", "]": "[", "}": "{"}


@contextlib.contextmanager
def deep() -> Iterator[None]:
    """Lift the limit on nested calls."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(2**31 - 1)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


class SyntaxFailure(Exception):
    """A syntax error at a character offset."""

    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.message = message
        self.offset = offset


class Tokens:
    """Token arrays of one text, with its comments and lexical errors."""

    __slots__ = ("comments", "errors", "inner", "kinds", "match", "newline", "starts", "text", "values", "ends")

    def __init__(self, text: str):
        self.text = text
        self.kinds: list[int] = []
        self.values: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.newline: list[bool] = []
        self.match: list[int] = []
        self.comments: list[tuple[int, int]] = []
        self.errors: list[tuple[str, int]] = []
        #: Tokens of the expressions within elements.
        self.inner: list[Tokens] = []

    def close(self, end: int | None = None) -> Tokens:
        """Add the end token and pair the brackets."""
        end = len(self.text) if end is None else end
        for _ in range(3):
            self.kinds.append(END)
            self.values.append("")
            self.starts.append(end)
            self.ends.append(end)
            self.newline.append(True)
        kinds, values = self.kinds, self.values
        match = [-1] * len(kinds)
        stack: list[int] = []
        for i, v in enumerate(values):
            if kinds[i] == PUNCT:
                if v in OPEN or v == "#[":
                    stack.append(i)
                elif v in CLOSE and stack:
                    want = values[stack[-1]]
                    if want == CLOSE[v] or (v == "]" and want == "#["):
                        match[stack.pop()] = i
        self.match = match
        return self


def remembered(lex):
    """A lexer that keeps its last result, as a text is often parsed and searched in turn."""
    slot: list = [None, None]

    def run(*arguments):
        if slot[0] != arguments:
            slot[1] = lex(*arguments)
            slot[0] = arguments
        return slot[1]

    run.__doc__ = lex.__doc__
    return run


class Parser:
    """Cursor and error store shared by all languages."""

    #: Names after which a parser that lost its way picks up again.
    resume: frozenset[str] = frozenset()

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.k, self.v = tokens.kinds, tokens.values
        self.nl, self.match = tokens.newline, tokens.match
        self.p = 0
        #: Statements and bodies around the current place.
        self.depth = 0
        self.errors: list[tuple[str, int]] = list(tokens.errors)

    def fail(self, message: str = "") -> None:
        p = min(self.p, len(self.k) - 1)
        raise SyntaxFailure(message or f"unexpected {self.v[p] or 'end of file'!r}", self.tokens.starts[p])

    def keep(self, e: SyntaxFailure) -> None:
        self.errors.append((e.message, e.offset))

    def at(self, value: str) -> bool:
        p = self.p
        return self.v[p] == value and self.k[p] == PUNCT

    def take(self, value: str) -> bool:
        p = self.p
        if self.v[p] == value and self.k[p] == PUNCT:
            self.p = p + 1
            return True
        return False

    def need(self, value: str) -> None:
        p = self.p
        if self.v[p] == value and self.k[p] == PUNCT:
            self.p = p + 1
        else:
            self.fail(f"expected {value!r}, found {self.v[p] or 'end of file'!r}")

    def word(self, value: str) -> bool:
        p = self.p
        return self.v[p] == value and self.k[p] == NAME

    def take_word(self, value: str) -> bool:
        p = self.p
        if self.v[p] == value and self.k[p] == NAME:
            self.p = p + 1
            return True
        return False

    def need_word(self, value: str) -> None:
        if not self.take_word(value):
            self.fail(f"expected {value!r}, found {self.v[self.p] or 'end of file'!r}")

    def attempt(self, rule) -> bool:
        """Run a rule; on failure step back and tell so."""
        p, depth = self.p, self.depth
        try:
            rule()
            return True
        except SyntaxFailure:
            self.p, self.depth = p, depth
            return False

    def panic(self, start: int) -> None:
        """Skip to a likely statement start after an error in the statement at start."""
        p, k, v, nl, match = max(self.p, start), self.k, self.v, self.nl, self.match
        if p == start and k[p] != END and v[p] != "}":
            p += 1
        while k[p] != END:
            x = v[p]
            if k[p] == PUNCT:
                if x == ";":
                    p += 1
                    break
                if x == "}":
                    break
                if x == "{" and match[p] > 0:
                    p = match[p] + 1
                    continue
            elif k[p] == NAME and nl[p] and x in self.resume:
                break
            p += 1
        self.p = p

    def statements(self, statement, until: str = "") -> None:
        """Statements up to the bracket or the end, each with its own recovery."""
        while True:
            p = self.p
            if self.k[p] == END:
                if until:
                    self.errors.append((f"expected {until!r}, found end of file", self.tokens.starts[p]))
                return
            if self.k[p] == PUNCT and self.v[p] == "}":
                if until:
                    return
                self.errors.append(("unexpected '}'", self.tokens.starts[p]))
                self.p += 1
                continue
            depth = self.depth
            try:
                statement()
            except SyntaxFailure as e:
                self.keep(e)
                self.depth = depth
                self.panic(p)
                if self.p <= p:
                    self.p = p + 1
