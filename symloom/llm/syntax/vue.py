"""Vue single-file components: blocks of the top level, the script within."""

from __future__ import annotations

import re

from . import ecma

_OPEN = re.compile(r"<([A-Za-z][\w.-]*)((?:\s+(?:[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|/(?!>)))*)\s*(/?)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NEXT = re.compile(r"<(?=[A-Za-z/!?])")
_RAW = ("script", "style")
_INNER = re.compile(r"\{\{|<(?=[A-Za-z/!?])")
_TEMPLATE_END = re.compile(r"</template\s*>")


def blocks(text: str) -> tuple[list[tuple[str, dict, int, int]], list[tuple[str, int]]]:
    """Top-level blocks as (tag, attributes, content start, content end), and errors."""
    found, errors = [], []
    pos = 1 if text.startswith("﻿") else 0
    while True:
        m = _NEXT.search(text, pos)
        if m is None:
            rest = text[pos:]
            break
        if text[pos : m.start()].strip():
            errors.append(("text outside the blocks", pos))
        pos = m.start()
        if text.startswith("<!--", pos):
            end = text.find("-->", pos + 4)
            if end < 0:
                errors.append(("unterminated comment", pos))
                rest = ""
                break
            pos = end + 3
            continue
        tag = _OPEN.match(text, pos)
        if tag is None:
            errors.append(("malformed tag", pos))
            pos += 1
            continue
        name = tag[1]
        attributes = {a[1]: a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(tag[2])}
        pos = tag.end()
        if tag[3]:
            found.append((name, attributes, pos, pos))
            continue
        if name == "template" and attributes.get("lang", "html") == "html":
            end = markup(text, pos)
        else:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, pos)
            end = (close.start(), close.end()) if close else None
        if end is None:
            errors.append((f"<{name}> is not closed", tag.start()))
            found.append((name, attributes, pos, len(text)))
            rest = ""
            break
        found.append((name, attributes, pos, end[0]))
        pos = end[1]
    if rest.strip():
        errors.append(("text outside the blocks", pos))
    return found, errors


def markup(text: str, pos: int) -> tuple[int, int] | None:
    """Walk a template to its own end tag over the elements in it; whether these nest is not the syntax asked for."""
    depth = 1
    while True:
        m = _INNER.search(text, pos)
        if m is None:
            return None
        pos = m.start()
        if m[0] == "{{":
            end = text.find("}}", pos)
            pos = end + 2 if end >= 0 else pos + 2
            continue
        if text.startswith("<!--", pos):
            end = text.find("-->", pos + 4)
            if end < 0:
                return None
            pos = end + 3
            continue
        close = _TEMPLATE_END.match(text, pos)
        if close:
            depth -= 1
            pos = close.end()
            if not depth:
                return m.start(), pos
            continue
        tag = _OPEN.match(text, pos)
        if tag is None:
            pos += 1
            continue
        pos = tag.end()
        depth += tag[1] == "template" and not tag[3]


def parse(text: str) -> list[tuple[str, int]]:
    """All syntax errors of a component as (message, offset), the first cause first."""
    found, errors = blocks(text)
    if not any(name in ("template", "script") for name, *_ in found):
        errors.append(("no template or script block", 0))
    for name, attributes, start, end in found:
        if name == "script" and "src" not in attributes:
            ts = attributes.get("lang", "js") in ("ts", "tsx", "typescript")
            tokens = ecma.lex(text[start:end], ts)
            parser = ecma.Ecma(tokens, ts)
            parser.module = True
            errors += [(m, start + at) for m, at in parser.program()]
    return sorted(errors, key=lambda e: e[1])
