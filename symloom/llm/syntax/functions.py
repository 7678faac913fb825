"""Functions of a source text and the documentation comments above them.

The lexers are state machines that know strings, templates and comments, so
braces in them do not count; matching brackets then delimit each function. A
comment belongs to a function when it ends on the line directly above the
head, or above the attributes and decorators that stand before the head.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

from . import csharp, ecma, php, vue
from .base import END, NAME, PRIVATE, PUNCT, STRING, Tokens, deep


class Function(NamedTuple):
    name: str
    start_line: int
    end_line: int
    head: int
    body: int
    end: int
    doc: str
    doc_start: int


_ECMA_HEAD = frozenset("export default async public private protected static readonly abstract override declare get set accessor".split())
_PHP_HEAD = frozenset("public private protected static abstract final".split())
_NOT_METHOD = frozenset("if for while switch catch with function return typeof new await do else super import".split())
_OBJECT_BEFORE = frozenset(("=", "(", "[", ",", ":", "?", "&&", "||", "??", "return", "default", "...", "as", "satisfies"))


def lexed(text: str, language: str, elements: bool = False) -> Tokens:
    if language == "php":
        return php.lex(text)
    if language == "csharp":
        return csharp.lex(text)
    return ecma.lex(text, language == "typescript", elements)


def scripts(text: str, language: str) -> list[tuple[str, str, int]]:
    """The parts of a text to read as code: (code, language, offset)."""
    if language != "vue":
        return [(text, language, 0)]
    out = []
    for tag, attributes, a, b in vue.blocks(text)[0]:
        if tag == "script" and b > a:
            ts = attributes.get("lang", "js") in ("ts", "tsx", "typescript")
            out.append((text[a:b], "typescript" if ts else "javascript", a))
    return out


def _lines(text: str) -> list[int]:
    """Offsets at which lines start, split at line feeds."""
    out = [0]
    find = text.find
    at = find("\n")
    while at >= 0:
        out.append(at + 1)
        at = find("\n", at + 1)
    return out


def functions(text: str, language: str, elements: bool = False) -> list[Function]:
    """All functions and methods with a body, in the order of their heads."""
    lines = _lines(text)
    out: list[Function] = []
    for code, lang, offset in scripts(text, language):
        with deep():
            tokens = lexed(code, lang, elements)
        if lang == "php":
            found = _php(tokens)
        elif lang == "csharp":
            found = _csharp(tokens)
        else:
            found = _ecma(tokens, lang == "typescript")
        comments = _Comments(text, tokens, offset, lines)
        for name, at, head, outer, body, end in found:
            starts, ends = tokens.starts, tokens.ends
            doc, doc_start = comments.above(starts[head] + offset, starts[outer] + offset)
            out.append(
                Function(
                    name,
                    bisect.bisect_right(lines, starts[at] + offset),
                    bisect.bisect_right(lines, ends[end] - 1 + offset),
                    starts[head] + offset,
                    starts[body] + offset,
                    ends[end] + offset,
                    doc,
                    doc_start,
                )
            )
    out.sort(key=lambda f: (f.head, f.start_line))
    return out


class _Comments:
    def __init__(self, text: str, tokens: Tokens, offset: int, lines: list[int]):
        self.text, self.lines = text, lines
        self.by_end: dict[int, tuple[int, int]] = {}
        for a, b in tokens.comments:
            a, b = a + offset, b + offset
            line = bisect.bisect_right(lines, a) - 1
            if text[lines[line] : a].strip(" \t\r\ufeff"):
                continue
            last = bisect.bisect_right(lines, b - 1) - 1
            after = text.find("\n", b)
            if text[b : after if after >= 0 else len(text)].strip():
                continue
            self.by_end[last] = (a, b)

    def above(self, head: int, outer: int) -> tuple[str, int]:
        line = bisect.bisect_right(self.lines, head) - 1
        found = self.by_end.get(line - 1)
        if found is None and outer < head:
            line = bisect.bisect_right(self.lines, outer) - 1
            found = self.by_end.get(line - 1)
        if found is None:
            return "", -1
        a, b = found
        mark = self.text[a : a + 2]
        if mark == "/*" or mark == "<!":
            return self.text[a:b], a
        line = bisect.bisect_right(self.lines, a) - 1
        first = a
        while True:
            line -= 1
            more = self.by_end.get(line)
            if more is None or self.text[more[0] : more[0] + 2] in ("/*", "<!"):
                break
            first = more[0]
        return self.text[first:b], first


def _contexts(tokens: Tokens, ts: bool) -> list[str]:
    """Of each token the kind of the braces directly around it: class, object or block."""
    kinds, values, match = tokens.kinds, tokens.values, tokens.match
    out = []
    stack: list[str] = ["block"]
    pending = -1
    depth = 0
    n = len(values)
    for i in range(n):
        v = values[i]
        if kinds[i] == NAME:
            if v == "class" and (i == 0 or values[i - 1] not in (".", "?.")) and values[i + 1] not in (":", ",", "=", ")"):
                pending = depth
        elif kinds[i] == PUNCT:
            if v == "{":
                before = values[i - 1] if i else ""
                if pending == depth and match[i] > 0:
                    kind, pending = "class", -1
                elif (before in _OBJECT_BEFORE) and not (before == ":" and _is_label(tokens, i - 1)):
                    kind = "object"
                else:
                    kind = "block"
                stack.append(kind)
                depth += 1
            elif v in ("(", "["):
                stack.append("group")
                depth += 1
            elif v in ("}", ")", "]"):
                if len(stack) > 1:
                    stack.pop()
                depth -= 1
        out.append(stack[-1])
    return out


def _is_label(tokens: Tokens, i: int) -> bool:
    """Whether a colon ends a case or default label."""
    values = tokens.values
    j = i - 1
    steps = 0
    while j >= 0 and steps < 40:
        v = values[j]
        if v in ("case", "default"):
            return True
        if v in (";", "{", "}", "?", ","):
            return False
        j -= 1
        steps += 1
    return False


def _after_type(tokens: Tokens, i: int, arrow: bool) -> int:
    """Index of the brace or arrow that follows a return type starting at i, or -1."""
    kinds, values, match = tokens.kinds, tokens.values, tokens.match
    angle = 0
    first = True
    while i < len(values):
        v = values[i]
        if kinds[i] == PUNCT:
            if v == "=>":
                if arrow and not angle and (values[i + 1] == "{" or not first):
                    return i
            elif v == "<":
                angle += 1
            elif v == ">":
                angle -= 1
            elif v == "{":
                if first or angle or values[i - 1] in ("|", "&", "=>", ":"):
                    if match[i] < 0:
                        return -1
                    i = match[i]
                else:
                    return -1 if arrow else i
            elif v in ("(", "["):
                if match[i] < 0:
                    return -1
                i = match[i]
            elif v in (";", "}", ")", "=") or (v == "," and not angle):
                return -1
        elif not kinds[i] or kinds[i] > 10:
            return -1
        first = False
        i += 1
    return -1


def _type_parameters(tokens: Tokens, i: int) -> int:
    """Index after type parameters that may start at i."""
    if tokens.values[i] != "<":
        return i
    depth = 0
    for j in range(i, min(i + 400, len(tokens.values))):
        v = tokens.values[j]
        if v == "<":
            depth += 1
        elif v == ">":
            depth -= 1
            if not depth:
                return j + 1
        elif v in (";", "{") and depth < 1:
            break
    return -1


def _ecma_body(tokens: Tokens, i: int, ts: bool) -> tuple[int, int]:
    """Brace and closing brace of a function whose parameters (or their types) start at i."""
    values, match = tokens.values, tokens.match
    if ts:
        i = _type_parameters(tokens, i)
    if i < 0 or values[i] != "(" or match[i] < 0:
        return -1, -1
    i = match[i] + 1
    if ts and values[i] == ":":
        i = _after_type(tokens, i + 1, False)
    if i < 0 or values[i] != "{" or tokens.kinds[i] != PUNCT or match[i] < 0:
        return -1, -1
    return i, match[i]


def _arrow_body(tokens: Tokens, i: int, ts: bool) -> tuple[int, int]:
    """Start and end of the body of an arrow function whose parameters start at i."""
    kinds, values, match = tokens.kinds, tokens.values, tokens.match
    if kinds[i] == NAME and values[i + 1] == "=>":
        i += 1
    else:
        if ts:
            i = _type_parameters(tokens, i)
        if i < 0 or values[i] != "(" or match[i] < 0:
            return -1, -1
        i = match[i] + 1
        if ts and values[i] == ":":
            i = _after_type(tokens, i + 1, True)
        if i < 0 or values[i] != "=>":
            return -1, -1
    i += 1
    if values[i] == "{" and kinds[i] == PUNCT:
        return (i, match[i]) if match[i] > 0 else (-1, -1)
    start = i
    while kinds[i] != END:
        v = values[i]
        if kinds[i] == PUNCT:
            if v in ("(", "[", "{"):
                if match[i] < 0:
                    return -1, -1
                i = match[i]
            elif v in (";", ",", ")", "]", "}"):
                break
        nl = tokens.newline[i + 1]
        if nl and kinds[i + 1] == NAME and values[i + 1] in ("const", "let", "var", "function", "class", "export", "import", "return", "if", "for"):
            return start, i
        i += 1
    return (start, i - 1) if i > start else (-1, -1)


def _ecma(tokens: Tokens, ts: bool) -> list[tuple[str, int, int, int, int, int]]:
    kinds, values, match = tokens.kinds, tokens.values, tokens.match
    around = _contexts(tokens, ts)
    out = []

    def heads(i: int) -> tuple[int, int]:
        """First token of the head, and of the decorators before it."""
        while i and kinds[i - 1] == NAME and values[i - 1] in _ECMA_HEAD:
            i -= 1
        outer = i
        while outer:
            j = outer - 1
            if values[j] == ")" and kinds[j] == PUNCT:
                opens = _open_of(tokens, j)
                if opens < 1:
                    break
                j = opens - 1
            k = j
            while k > 1 and kinds[k] == NAME and values[k - 1] == ".":
                k -= 2
            if kinds[k] == NAME and k and values[k - 1] == "@":
                outer = k - 1
            else:
                break
        return i, outer

    for i, v in enumerate(values):
        k = kinds[i]
        if k == NAME:
            if v == "function" and values[i - 1 if i else 0] != ".":
                j = i + 1
                if values[j] == "*":
                    j += 1
                before = values[i - 1] if i else ""
                at = i - 1 if before == "async" else i
                if kinds[j] == NAME and (at == 0 or values[at - 1] in (";", "}", "{", "export", "default", "declare", ")") or tokens.newline[at]):
                    if values[at - 1] in ("=", "(", ",", "=>", "return") and at:
                        continue
                    body, end = _ecma_body(tokens, j + 1, ts)
                    if body > 0:
                        head, outer = heads(i)
                        out.append((values[j], j, head, outer, body, end))
                continue
            if v == "const" and kinds[i + 1] == NAME and kinds[i + 2] == PUNCT:
                j = i + 2
                if ts and values[j] == ":":
                    depth = 0
                    while kinds[j] != END and not (values[j] == "=" and not depth):
                        x = values[j]
                        if x in ("(", "[", "{") and match[j] > 0:
                            j = match[j]
                        elif x == "<":
                            depth += 1
                        elif x == ">":
                            depth -= 1
                        elif x == ";":
                            break
                        j += 1
                if values[j] != "=":
                    continue
                j += 1
                if values[j] == "async" and kinds[j + 1] in (NAME, PUNCT) and values[j + 1] not in (".", ",", ";", ")"):
                    j += 1
                if values[j] == "function" and kinds[j] == NAME:
                    j += 1
                    if values[j] == "*":
                        j += 1
                    if kinds[j] == NAME:
                        j += 1
                    body, end = _ecma_body(tokens, j, ts)
                else:
                    body, end = _arrow_body(tokens, j, ts)
                if body > 0:
                    head, outer = heads(i)
                    out.append((values[i + 1], i + 1, head, outer, body, end))
                continue
        if k in (NAME, STRING, PRIVATE) and values[i + 1] in ("(", "<") and around[i] in ("class", "object") and (k != NAME or v not in _NOT_METHOD):
            before = values[i - 1] if i else ""
            j = i
            if before == "*" and kinds[i - 1] == PUNCT:
                j = i - 1
                before = values[j - 1]
            head, outer = heads(j)
            edge = values[outer - 1] if outer else ""
            if not (edge in ("{", "}", ",", ";") or tokens.newline[outer]):
                continue
            body, end = _ecma_body(tokens, i + 1, ts)
            if body > 0:
                name = v[1:-1] if k == STRING else v
                out.append((name, i, head, outer, body, end))
    return out


def _open_of(tokens: Tokens, close: int) -> int:
    """Index of the bracket that the closing bracket at an index matches."""
    want = {")": "(", "]": "[", "}": "{"}[tokens.values[close]]
    depth = 0
    for j in range(close, -1, -1):
        if tokens.kinds[j] != PUNCT:
            continue
        v = tokens.values[j]
        if v == tokens.values[close]:
            depth += 1
        elif v == want or (want == "[" and v == "#["):
            depth -= 1
            if not depth:
                return j
    return -1


def _php(tokens: Tokens) -> list[tuple[str, int, int, int, int, int]]:
    kinds, values, match = tokens.kinds, tokens.values, tokens.match
    out = []
    for i, v in enumerate(values):
        if kinds[i] != NAME or v.lower() != "function":
            continue
        j = i + 1
        if values[j] == "&":
            j += 1
        if kinds[j] != NAME or values[j + 1] != "(" or match[j + 1] < 0:
            continue
        body = match[j + 1] + 1
        if values[body] == ":":
            body += 1
            while kinds[body] == NAME or values[body] in ("?", "|", "&", "(", ")"):
                body += 1
        if values[body] != "{" or match[body] < 0:
            continue
        head = i
        while head and kinds[head - 1] == NAME and values[head - 1].lower() in _PHP_HEAD:
            head -= 1
        outer = head
        while outer and values[outer - 1] == "]":
            opens = _open_of(tokens, outer - 1)
            if opens < 0 or values[opens] != "#[":
                break
            outer = opens
        out.append((values[j], j, head, outer, body, match[body]))
    return out


_CS_TYPE_END = frozenset((">", "]", "?", ")", "*"))


def _csharp(tokens: Tokens) -> list[tuple[str, int, int, int, int, int]]:
    kinds, values, match = tokens.kinds, tokens.values, tokens.match
    out = []
    for i, v in enumerate(values):
        if kinds[i] != NAME or v in csharp.RESERVED or not i:
            continue
        j = i + 1
        if values[j] == "<":
            j = _type_parameters(tokens, j)
            if j < 0:
                continue
        if values[j] != "(" or kinds[j] != PUNCT or match[j] < 0:
            continue
        before, kind = values[i - 1], kinds[i - 1]
        first = i
        while before == "." and first > 1 and kinds[first - 2] == NAME:
            first -= 2
            before, kind = values[first - 1] if first else "", kinds[first - 1]
        if kind == NAME:
            if before in csharp.RESERVED and before not in csharp._BUILTIN and before not in csharp._MODIFIERS:
                continue
            if before in ("await", "yield", "when", "and", "or", "not", "is", "as", "from", "select", "where", "record"):
                continue
        elif not (kind == PUNCT and before in _CS_TYPE_END):
            continue
        body = match[j] + 1
        if values[body] == ":" and values[body + 1] in ("base", "this") and values[body + 2] == "(" and match[body + 2] > 0:
            body = match[body + 2] + 1
        while values[body] == "where" and kinds[body] == NAME:
            body += 1
            while kinds[body] != END and values[body] not in ("{", "=>", ";", "where"):
                body = match[body] + 1 if values[body] == "(" and match[body] > 0 else body + 1
        if values[body] == "{" and match[body] > 0:
            end = match[body]
        elif values[body] == "=>":
            body += 1
            end = body
            while kinds[end] != END and values[end] != ";":
                if values[end] in ("(", "[", "{") and kinds[end] == PUNCT:
                    if match[end] < 0:
                        break
                    end = match[end]
                elif values[end] in (",", ")", "}", "]") and kinds[end] == PUNCT:
                    end = -1
                    break
                end += 1
            if end < 0 or values[end] != ";":
                continue
        else:
            continue
        outer = first
        while outer and not (kinds[outer - 1] == PUNCT and values[outer - 1] in (";", "{", "}")):
            outer -= 1
            if values[outer] in (")", "]") and kinds[outer] == PUNCT:
                opens = _open_of(tokens, outer)
                if opens < 0:
                    break
                outer = opens
        head = outer
        while values[head] == "[" and match[head] > 0 and match[head] < i:
            head = match[head] + 1
        if values[head] in ("case", "=", "return", "throw", "new", "(", ".", "?") or any(values[x] == "=" and kinds[x] == PUNCT for x in range(head, first)):
            continue
        out.append((v, i, head, outer, body, end))
    return out


# documentation

#: Directives to tools, not to readers (fixed spellings of these tools).
_DIRECTIVE = re.compile(
    r"\b(?:eslint(?:-\w+)*|tslint|istanbul|c8|v8|prettier|stylelint|biome|jshint|jslint|phpcs|phpstan|psalm|noinspection|ReSharper|pragma|nolint|sonar\w*|webpack\w+|vite-ignore|type-coverage|codecov|coverage)\b(?::|\s+(?:ignore|disable|enable|off|on|once|restore|suppress)|-(?:ignore|disable|enable))[^\n]*|^\s*(?:NOSONAR|NOLINT|CS\d+)\b.*",
    re.I | re.M,
)
_TAG_LINE = re.compile(r"^\s*@[\w:\\-]+(?:\s+\{(?:[^{}]|\{[^{}]*\})*\})?.*$", re.M)
_XML_TAG = re.compile(r"<(param|typeparam|exception|returns|value|see|seealso|example|code|c|paramref|inheritdoc)\b[^>]*?(?:/>|>(.*?)</\1\s*>|>)", re.S | re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ARTICLES = frozenset("a an the function der die das ein eine le la les un une".split())
#: Words of remarks that only say that documentation is missing, inherited or still to come.
_EMPTY_WORDS = frozenset(
    """todo fixme tbd tba xxx hack wip add write put provide fill insert supply complete create update describe explain document documented documents undocumented
    description descriptions documentation doc docs docblock comment comments text summary details explanation information info javadoc phpdoc jsdoc
    proper better real useful meaningful short full missing absent empty none nothing no not yet nor available given needed required needs need need to be is are was been being has have had
    still later soon here there this that these it its of for from in on at by as with and or the a an will should must shall may can could would do does done please pending placeholder stub
    inherited inherits inherit inheritdoc inheritance parent base super class interface superclass ancestor overridden override overrides overriding implementation implemented implements
    see above below same previous next said method function member property item code what how why when who follows following follow written writing come coming added goes go
    beschreibung dokumentation kommentar fehlt fehlen noch wird werden ergänzt ergänzen siehe oben unten geerbt vererbt von der die das des dem hier folgt später nachgetragen keine nicht vorhanden muss müssen schreiben methode funktion klasse basis
    description manquante à compléter écrire plus tard voir ci-dessus hérité hérite de la le documentation méthode fonction classe n/a na""".split()
)


def prose(doc: str) -> str:
    """The text of a documentation comment without marks, tags, directives and rulers."""
    out = []
    for line in re.split(r"\r\n|\n|\r", doc):
        s = line.strip()
        s = re.sub(r"^(?:/\*+!?|//+!?|\*+(?!/)|#+)", "", s)
        s = re.sub(r"\*+/\s*$", "", s)
        out.append(s.strip())
    text = "\n".join(out)
    text = re.sub(r"\{@inheritdoc\}|\{@\w+[^}]*\}", " ", text, flags=re.I)
    text = _TAG_LINE.sub("", text)
    text = _XML_TAG.sub(" ", text)
    text = re.sub(r"</?[A-Za-z][^<>\n]*>", " ", text)
    text = _DIRECTIVE.sub("", text)
    kept = []
    for line in text.split("\n"):
        s = line.strip()
        if not s or not re.search(r"[^\W_]", s) or _is_code(s):
            continue
        kept.append(s)
    return "\n".join(kept)


def _is_code(line: str) -> bool:
    """Whether a comment line is code that was commented out."""
    return bool(
        re.search(r"(?:\)|\w|[\"'\]}])\s*;\s*\}?\s*$|=>|^\}|[)\w]\s*\{\s*$", line)
        and re.search(r"[(){}=;]", line)
        and re.search(r"\w\(|\)\s*\{|\w\s=\s|^return\b|^\}|=>|^(?:const|let|var|if|for|while)\b", line)
    )


def name_words(name: str) -> list[str]:
    parts = re.findall(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|\d+", name)
    return [p.lower() for p in parts]


def _same(word: str, named: set[str]) -> bool:
    """Whether a word is a word of the name, in this or an inflected form."""
    if word in named:
        return True
    for end in ("s", "es", "ed", "d", "ing", "ies", "ied"):
        if word.endswith(end) and len(word) > len(end) + 1:
            stem = word[: -len(end)]
            if stem in named or stem + "e" in named or stem + "y" in named or (len(stem) > 2 and stem[-1] == stem[-2] and stem[:-1] in named):
                return True
    return any(n.endswith("s") and n[:-1] == word for n in named)


def describes(doc: str, name: str) -> str:
    """The prose of a comment that says something about the function, else an empty text."""
    text = prose(doc)
    words = [w.lower() for w in _WORD.findall(text)]
    if len(words) < 5:
        return ""
    named = set(name_words(name))
    if all(w in _ARTICLES or _same(w, named) or w.replace("-", "") == name.lower() for w in words):
        return ""
    if all(w in _EMPTY_WORDS or w in named for w in words):
        return ""
    return " ".join(text.split())
