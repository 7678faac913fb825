"""PHP 8.1."""

from __future__ import annotations

import re

from .base import END, NAME, NUMBER, PUNCT, STRING, Parser, Tokens, remembered

VARIABLE = 20
INLINE = 21

_TOKEN = re.compile(
    r"\s*(?:"
    r"(\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)"
    r"|(\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)"
    r"|(0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?)"
    r"|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`)"
    r"|(//[^\n\r]*?(?=\?>|[\n\r]|\Z)|\#(?!\[)[^\n\r]*?(?=\?>|[\n\r]|\Z)|/\*.*?\*/)"
    r"|(<<<[ \t]*(?:\"[A-Za-z_]\w*\"|'[A-Za-z_]\w*'|[A-Za-z_]\w*)\r?\n)"
    r"|(\?>\r?\n?)"
    r"|(\#\[|\?\?=|\?->|\.\.\.|===|!==|<=>|\*\*=|<<=|>>=|\*\*|\?\?|->|=>|::|\+\+|--|==|!=|<>|<=|>=|&&|\|\||<<|>>|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@$])"
    r"|(\Z))",
    re.S,
)
_CAST = re.compile(r"\(\s*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)\s*\)", re.I)
_OPEN = re.compile(r"<\?(?:php(?=\s|\Z)|=)", re.I)
#: A variable in a double-quoted text, with one step of access.
_HOLE = re.compile(r"\$\{|\{\$")


@remembered
def lex(text: str) -> Tokens:
    """Tokens of a PHP file, text outside the tags as inline tokens."""
    out = Tokens(text)
    kinds, values, starts, ends, newline = out.kinds, out.values, out.starts, out.ends, out.newline

    def put(kind: int, value: str, a: int, b: int) -> None:
        kinds.append(kind)
        values.append(value)
        starts.append(a)
        ends.append(b)
        newline.append(True)

    pos = 1 if text.startswith("﻿") else 0
    m = _OPEN.search(text, pos)
    if m is None:
        if text[pos:].strip() and pos < len(text):
            put(INLINE, "", pos, len(text))
        return out.close()
    if m.start() > pos:
        put(INLINE, "", pos, m.start())
    if m[0] == "<?=":
        put(NAME, "echo", m.start(), m.end())
    pos = m.end()
    token = _TOKEN.match
    while True:
        m = token(text, pos)
        if m is None:
            at = pos
            while at < len(text) and text[at].isspace():
                at += 1
            if at >= len(text):
                break
            if text.startswith("/*", at):
                out.errors.append(("unterminated comment", at))
                break
            if text[at] in "\"'`":
                out.errors.append(("unterminated string", at))
                put(STRING, "", at, len(text))
                break
            out.errors.append((f"unexpected character {text[at]!r}", at))
            pos = at + 1
            continue
        g = m.lastindex
        a, pos = m.span(g)
        if g == 1:
            put(NAME, m[1], a, pos)
        elif g == 2:
            put(VARIABLE, m[2], a, pos)
        elif g == 8:
            if m[8] == "/" and text.startswith("/*", a):
                out.errors.append(("unterminated comment", a))
                break
            if m[8] == "(":
                cast = _CAST.match(text, a)
                if cast:
                    pos = cast.end()
                    put(PUNCT, "(cast)", a, pos)
                    continue
            put(PUNCT, m[8], a, pos)
        elif g == 4:
            put(STRING, m[4], a, pos)
            if m[4][0] != "'" and ("${" in m[4] or "{$" in m[4]):
                _holes(text, a + 1, pos - 1, out)
        elif g == 5:
            out.comments.append((a, pos))
        elif g == 3:
            if text[pos : pos + 1].isalnum():
                out.errors.append(("malformed number", a))
            put(NUMBER, m[3], a, pos)
        elif g == 6:
            word = re.search(r"[A-Za-z_]\w*", m[6])[0]
            end = re.compile(rf"^[ \t]*{word}\b", re.M).search(text, pos)
            if end is None:
                out.errors.append(("unterminated heredoc", a))
                break
            if "'" not in m[6]:
                _holes(text, pos, end.start(), out)
            pos = end.end()
            put(STRING, m[6], a, pos)
        elif g == 7:
            put(PUNCT, ";", a, a)
            n = _OPEN.search(text, pos)
            end = n.start() if n else len(text)
            if end > pos:
                put(INLINE, "", pos, end)
            if n is None:
                break
            if n[0] == "<?=":
                put(NAME, "echo", n.start(), n.end())
            pos = n.end()
        else:
            break
    return out.close()


def _holes(text: str, start: int, end: int, out: Tokens) -> None:
    """Check that `{$` and `${` within an interpolated text are closed."""
    pos = start
    while True:
        m = _HOLE.search(text, pos, end)
        if m is None:
            return
        if m.start() > start and text[m.start() - 1] == "\\":
            pos = m.end()
            continue
        level, i = 1, m.end()
        while i < end and level:
            level += (text[i] == "{") - (text[i] == "}")
            i += 1
        if level:
            out.errors.append(("interpolation is not closed", m.start()))
            return
        pos = i


_BINARY = {
    "or": 1, "xor": 2, "and": 3, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12, "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13,
    "<": 14, ">": 14, "<=": 14, ">=": 14, ".": 15, "<<": 16, ">>": 16, "+": 17, "-": 17, "*": 18, "/": 18, "%": 18, "instanceof": 20, "**": 21,
}
_ASSIGN = frozenset("= += -= *= /= .= %= **= ??= &= |= ^= <<= >>=".split())
#: Words that cannot name a class, function or constant (fixed by the language).
RESERVED = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public require require_once return static switch throw trait try unset use var while xor yield".split()
)
_MODIFIERS = frozenset("public private protected static abstract final var readonly".split())
VALUE, TARGET, PATTERN = 0, 1, 2


class Php(Parser):
    resume = frozenset("function class if for foreach while switch try return namespace use public private protected abstract final interface trait echo".split())

    def __init__(self, tokens: Tokens):
        super().__init__(tokens)
        self.low = [x.lower() if k == NAME else x for k, x in zip(tokens.kinds, tokens.values, strict=True)]
        self.v = self.low
        self.words = {
            "if": self.if_, "while": self.while_, "do": self.do_, "for": self.for_, "foreach": self.foreach, "switch": self.switch, "try": self.try_,
            "return": self.return_, "break": self.break_, "continue": self.break_, "echo": self.echo, "global": self.global_, "unset": self.unset,
            "namespace": self.namespace, "use": self.use, "const": self.const, "declare": self.declare, "goto": self.goto, "throw": self.statement_expression,
            "class": self.class_, "interface": self.class_, "trait": self.class_, "abstract": self.class_, "final": self.class_, "{": self.block, ";": self.empty, "#[": self.attributed,
        }

    def program(self) -> list[tuple[str, int]]:
        if not any(k not in (INLINE, END) for k in self.k):
            text = self.tokens.text
            self.errors.append(("no PHP code", 0) if text.strip() else ("empty file", 0))
        self.statements(self.statement)
        return self.errors

    def statement(self) -> None:
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == INLINE:
            self.p = p + 1
            return
        if k == NAME or k == PUNCT:
            rule = self.words.get(v)
            if rule is not None:
                if v == "namespace" and self.v[p + 1].startswith("\\") or (v == "readonly"):
                    pass
                else:
                    rule()
                    return
            if v == "function" and (self.k[p + 1] == NAME or (self.v[p + 1] == "&" and self.k[p + 2] == NAME)):
                self.p = p + 1
                self.take("&")
                self.p += 1
                self.function_rest()
                return
            if v == "static" and self.k[p + 1] == VARIABLE:
                self.p = p + 1
                while True:
                    if self.k[self.p] != VARIABLE:
                        self.fail()
                    self.p += 1
                    if self.take("="):
                        self.expression()
                    if not self.take(","):
                        break
                self.end()
                return
            if v == "enum" and self.k[p + 1] == NAME and self.v[p + 1] not in ("extends", "implements"):
                self.class_()
                return
            if k == NAME and self.v[p + 1] == ":" and v not in RESERVED and self.v[p + 2] != ":":
                self.p = p + 2
                return
        self.expression()
        self.end()

    def statement_expression(self) -> None:
        self.expression()
        self.end()

    def end(self) -> None:
        if self.k[self.p] == PUNCT and self.v[self.p] == ";":
            self.p += 1
        else:
            self.fail()

    def empty(self) -> None:
        self.p += 1

    def block(self) -> None:
        self.need("{")
        self.statements(self.statement, "}")
        self.take("}")

    def attributed(self) -> None:
        self.attributes()
        self.statement()

    def attributes(self) -> None:
        while self.take("#["):
            while not self.take("]"):
                self.class_name()
                if self.at("("):
                    self.arguments()
                if not self.at("]"):
                    self.need(",")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def body(self, *ends: str) -> None:
        """A statement, or the colon form up to one of the closing words."""
        if ends and self.take(":"):
            while not (self.k[self.p] == NAME and self.v[self.p] in ends):
                if self.k[self.p] == END:
                    self.fail()
                self.statement()
            return
        self.statement()

    def if_(self) -> None:
        self.p += 1
        self.condition()
        if self.at(":"):
            self.body("elseif", "else", "endif")
            while self.take_word("elseif"):
                self.condition()
                self.body("elseif", "else", "endif")
            if self.take_word("else"):
                if self.word("if"):
                    self.fail()
                self.body("endif")
            self.need_word("endif")
            self.end()
            return
        self.statement()
        while self.take_word("elseif"):
            self.condition()
            self.statement()
        if self.take_word("else"):
            self.statement()

    def closing(self, word: str) -> None:
        colon = self.at(":")
        self.body(word)
        if colon:
            self.need_word(word)
            self.end()

    def while_(self) -> None:
        self.p += 1
        self.condition()
        self.closing("endwhile")

    def do_(self) -> None:
        self.p += 1
        self.statement()
        self.need_word("while")
        self.condition()
        self.end()

    def for_(self) -> None:
        self.p += 1
        self.need("(")
        for end in (";", ";", ")"):
            if not self.at(end):
                self.expression()
                while self.take(","):
                    self.expression()
            self.need(end)
        self.closing("endfor")

    def foreach(self) -> None:
        self.p += 1
        self.need("(")
        self.expression()
        self.need_word("as")
        self.take("&")
        self.operand()
        if self.take("=>"):
            self.take("&")
            self.operand()
        self.need(")")
        self.closing("endforeach")

    def switch(self) -> None:
        self.p += 1
        self.condition()
        colon = self.take(":")
        if not colon:
            self.need("{")
        self.take(";")
        while not (self.word("endswitch") if colon else self.at("}")):
            if self.take_word("case"):
                self.expression()
            else:
                self.need_word("default")
            if not self.take(";"):
                self.need(":")
            while not (self.at("}") or (self.k[self.p] == NAME and self.v[self.p] in ("case", "default", "endswitch"))):
                if self.k[self.p] == END:
                    self.fail()
                self.statement()
        self.p += 1
        if colon:
            self.end()

    def try_(self) -> None:
        self.p += 1
        self.block()
        done = False
        while self.take_word("catch"):
            done = True
            self.need("(")
            self.class_name()
            while self.take("|"):
                self.class_name()
            if self.k[self.p] == VARIABLE:
                self.p += 1
            self.need(")")
            self.block()
        if self.take_word("finally"):
            done = True
            self.block()
        if not done:
            self.fail("expected catch or finally")

    def return_(self) -> None:
        self.p += 1
        if not self.at(";"):
            self.expression()
        self.end()

    def break_(self) -> None:
        self.p += 1
        if self.k[self.p] == NUMBER:
            self.p += 1
        self.end()

    def echo(self) -> None:
        self.p += 1
        self.expression()
        while self.take(","):
            self.expression()
        self.end()

    def global_(self) -> None:
        self.p += 1
        self.operand()
        while self.take(","):
            self.operand()
        self.end()

    def unset(self) -> None:
        self.p += 1
        self.need("(")
        while not self.take(")"):
            self.expression()
            if not self.at(")"):
                self.need(",")
        self.end()

    def goto(self) -> None:
        self.p += 1
        self.class_name()
        self.end()

    def namespace(self) -> None:
        self.p += 1
        if self.k[self.p] == NAME:
            self.p += 1
        if self.at("{"):
            self.block()
        else:
            self.end()

    def use(self) -> None:
        self.p += 1
        while True:
            if self.k[self.p] == NAME and self.v[self.p] in ("function", "const") and self.k[self.p + 1] == NAME:
                self.p += 1
            self.class_name()
            if self.at("{") or (self.v[self.p] == "\\"):
                self.need("{")
            elif self.take_word("as"):
                self.class_name()
            if not self.take(","):
                break
        self.end()

    def const(self) -> None:
        self.p += 1
        while True:
            if self.k[self.p] != NAME:
                self.fail("expected a name")
            self.p += 1
            self.need("=")
            self.expression()
            if not self.take(","):
                break
        self.end()

    def declare(self) -> None:
        self.p += 1
        self.need("(")
        while True:
            self.class_name()
            self.need("=")
            self.expression()
            if not self.take(","):
                break
        self.need(")")
        if self.at("{") or self.at(":"):
            self.closing("enddeclare")
        else:
            self.end()

    def class_name(self) -> None:
        if self.k[self.p] != NAME:
            self.fail("expected a name")
        self.p += 1

    def class_(self) -> None:
        while self.k[self.p] == NAME and self.v[self.p] in ("abstract", "final", "readonly"):
            self.p += 1
        kind = self.v[self.p]
        if kind not in ("class", "interface", "trait", "enum"):
            self.fail()
        self.p += 1
        if self.k[self.p] != NAME or self.v[self.p] in RESERVED:
            self.fail("expected a class name")
        self.p += 1
        if kind == "enum" and self.take(":"):
            self.type()
        self.class_rest()

    def class_rest(self) -> None:
        if self.take_word("extends"):
            self.class_name()
            while self.take(","):
                self.class_name()
        if self.take_word("implements"):
            self.class_name()
            while self.take(","):
                self.class_name()
        self.need("{")
        self.statements(self.member, "}")
        self.need("}")

    def member(self) -> None:
        self.attributes()
        if self.take_word("use"):
            self.class_name()
            while self.take(","):
                self.class_name()
            if self.take("{"):
                while not self.take("}"):
                    self.class_name()
                    if self.take("::"):
                        self.class_name()
                    if self.take_word("insteadof"):
                        self.class_name()
                        while self.take(","):
                            self.class_name()
                    else:
                        self.need_word("as")
                        self.class_name()
                        if self.k[self.p] == NAME:
                            self.p += 1
                    self.end()
            else:
                self.end()
            return
        if self.take_word("case"):
            self.class_name()
            if self.take("="):
                self.expression()
            self.end()
            return
        p = self.p
        while self.k[self.p] == NAME and self.v[self.p] in _MODIFIERS:
            self.p += 1
        some = self.p > p
        if self.word("const"):
            self.p += 1
            if self.k[self.p] == NAME and self.k[self.p + 1] == NAME:
                self.p += 1
            self.p -= 1
            self.const()
            return
        if self.take_word("function"):
            self.take("&")
            if self.k[self.p] != NAME:
                self.fail("expected a function name")
            self.p += 1
            self.function_rest(member=True)
            return
        if not some:
            self.fail()
        if self.k[self.p] != VARIABLE:
            self.type()
        while True:
            if self.k[self.p] != VARIABLE:
                self.fail()
            self.p += 1
            if self.take("="):
                self.expression()
            if not self.take(","):
                break
        self.end()

    def type(self) -> None:
        self.take("?")
        while True:
            if self.take("("):
                self.type()
                self.need(")")
            elif self.k[self.p] == NAME:
                self.p += 1
            else:
                self.fail("expected a type")
            if self.at("&") and (self.k[self.p + 1] == VARIABLE or self.v[self.p + 1] in ("...", "&")):
                return
            if not (self.take("|") or self.take("&")):
                return

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.attributes()
            while self.k[self.p] == NAME and self.v[self.p] in ("public", "private", "protected", "readonly"):
                self.p += 1
            if self.k[self.p] == NAME or self.v[self.p] in ("?", "("):
                self.type()
            self.take("&")
            self.take("...")
            if self.k[self.p] != VARIABLE:
                self.fail("expected a parameter")
            self.p += 1
            if self.take("="):
                self.expression()
            if not self.at(")"):
                self.need(",")

    def function_rest(self, member: bool = False) -> None:
        self.parameters()
        if self.take_word("use"):
            self.need("(")
            while not self.take(")"):
                self.take("&")
                if self.k[self.p] != VARIABLE:
                    self.fail()
                self.p += 1
                if not self.at(")"):
                    self.need(",")
        if self.take(":"):
            self.type()
        if member and self.take(";"):
            return
        self.block()

    def expression(self) -> None:
        self.binary(0)

    def binary(self, least: int) -> None:
        kind = self.operand()
        k, v = self.k, self.v
        while True:
            p = self.p
            if k[p] != PUNCT and k[p] != NAME:
                return
            x = v[p]
            if x in _ASSIGN and k[p] == PUNCT:
                if kind == VALUE or (kind == PATTERN and x != "="):
                    self.fail("invalid assignment target")
                self.p = p + 1
                if x == "=":
                    self.take("&")
                self.binary(4)
                kind = VALUE
                continue
            if x == "?" and k[p] == PUNCT:
                if least >= 6:
                    return
                self.p = p + 1
                if not self.take(":"):
                    self.binary(4)
                    self.need(":")
                self.binary(6)
                kind = VALUE
                continue
            level = _BINARY.get(x)
            if level is None or level <= least:
                return
            self.p = p + 1
            self.binary(level - 1 if x in ("??", "**") else level)
            kind = VALUE

    def operand(self) -> int:
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == PUNCT:
            if v in ("!", "-", "+", "~", "@", "&", "(cast)"):
                if v == "&":
                    self.fail()
                self.p = p + 1
                self.binary(19)
                return VALUE
            if v in ("++", "--"):
                self.p = p + 1
                if self.operand() != TARGET:
                    self.fail("invalid target")
                return VALUE
        elif k == NAME:
            if v == "new":
                self.p = p + 1
                self.new()
                return self.postfix(VALUE)
            if v in ("clone", "print", "include", "include_once", "require", "require_once"):
                self.p = p + 1
                self.binary(19 if v == "clone" else 4)
                return VALUE
            if v == "throw":
                self.p = p + 1
                self.binary(0)
                return VALUE
            if v == "yield":
                self.p = p + 1
                if self.take_word("from"):
                    self.binary(4)
                elif not (self.k[self.p] == PUNCT and self.v[self.p] in (";", ")", "]", ",")):
                    self.binary(4)
                    if self.take("=>"):
                        self.binary(4)
                return VALUE
        return self.primary()

    def new(self) -> None:
        self.attributes()
        if self.word("class"):
            self.p += 1
            if self.at("("):
                self.arguments()
            self.class_rest()
            return
        if self.k[self.p] == NAME:
            if self.v[self.p] in RESERVED and self.v[self.p] != "static":
                self.fail()
            self.p += 1
        elif self.k[self.p] == VARIABLE:
            self.p += 1
            while True:
                if self.at("->") or self.at("?->") or self.at("::"):
                    self.p += 1
                    if self.k[self.p] not in (NAME, VARIABLE):
                        self.fail()
                    self.p += 1
                elif self.take("["):
                    self.expression()
                    self.need("]")
                else:
                    break
        elif self.take("("):
            self.expression()
            self.need(")")
        else:
            self.fail()
        if self.at("("):
            self.arguments()

    def arguments(self) -> None:
        self.need("(")
        if self.at("...") and self.v[self.p + 1] == ")":
            self.p += 2
            return
        while not self.take(")"):
            if self.k[self.p] == NAME and self.v[self.p + 1] == ":" and self.k[self.p + 1] == PUNCT:
                self.p += 2
            else:
                self.take("...")
            self.expression()
            if not self.at(")"):
                self.need(",")

    def primary(self) -> int:
        p = self.p
        k, v = self.k[p], self.v[p]
        kind = VALUE
        if k == VARIABLE:
            self.p = p + 1
            kind = TARGET
        elif k == STRING or k == NUMBER:
            self.p = p + 1
        elif k == NAME:
            if v in ("function", "fn") or (v == "static" and self.v[p + 1] in ("function", "fn")):
                self.p = p + 1
                self.closure(self.v[self.p - 1] if v != "static" else self.word_after())
                return self.postfix(VALUE)
            if v in ("isset", "empty", "exit", "die", "array", "list"):
                self.p = p + 1
                if v in ("array", "list") and self.at("("):
                    self.items(")")
                    return self.postfix(PATTERN)
                if self.at("("):
                    self.p += 1
                    while not self.take(")"):
                        self.expression()
                        if not self.at(")"):
                            self.need(",")
                elif v in ("isset", "empty", "list"):
                    self.fail()
                return VALUE
            if v == "match" and self.v[p + 1] == "(":
                self.match_()
                return self.postfix(VALUE)
            if v in RESERVED and v not in ("static", "namespace", "enum"):
                self.fail()
            self.p = p + 1
        elif k == PUNCT:
            if v == "(":
                self.p = p + 1
                self.expression()
                self.need(")")
            elif v == "[":
                self.items("]")
                kind = PATTERN
            elif v == "$":
                self.p = p + 1
                if self.take("{"):
                    self.expression()
                    self.need("}")
                else:
                    self.primary()
                kind = TARGET
            elif v == "#[":
                self.attributes()
                return self.primary()
            else:
                self.fail()
        else:
            self.fail()
        return self.postfix(kind)

    def word_after(self) -> str:
        self.p += 1
        return self.v[self.p - 1]

    def closure(self, word: str) -> None:
        self.take("&")
        if word == "function":
            self.function_rest()
            return
        self.parameters()
        if self.take(":"):
            self.type()
        self.need("=>")
        self.binary(4)

    def match_(self) -> None:
        self.p += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.word("default") and self.v[self.p + 1] in ("=>", ","):
                self.p += 1
                self.take(",")
            else:
                self.expression()
                while self.take(","):
                    if self.at("=>"):
                        break
                    self.expression()
            self.need("=>")
            self.expression()
            if not self.at("}"):
                self.need(",")

    def items(self, close: str) -> None:
        self.p += 1
        while not self.take(close):
            if self.take(","):
                continue
            if self.take("...") or self.take("&"):
                self.expression()
            else:
                self.expression()
                if self.take("=>"):
                    self.take("&")
                    self.expression()
            if not self.at(close):
                self.need(",")

    def postfix(self, kind: int) -> int:
        k, v = self.k, self.v
        while True:
            p = self.p
            if k[p] != PUNCT:
                return kind
            x = v[p]
            if x == "->" or x == "?->" or x == "::":
                self.p = p + 1
                n = self.p
                if k[n] in (NAME, VARIABLE):
                    self.p = n + 1
                elif v[n] == "{" and k[n] == PUNCT:
                    self.p = n + 1
                    self.expression()
                    self.need("}")
                elif v[n] == "$":
                    self.primary()
                else:
                    self.fail()
                kind = TARGET
            elif x == "[":
                self.p = p + 1
                if not self.take("]"):
                    self.expression()
                    self.need("]")
                kind = TARGET
            elif x == "(":
                self.arguments()
                kind = VALUE
            elif x == "++" or x == "--":
                if kind != TARGET:
                    self.fail("invalid target")
                self.p = p + 1
                return VALUE
            else:
                return kind


def parse(text: str) -> list[tuple[str, int]]:
    """All syntax errors of a PHP file as (message, offset), the first cause first."""
    return sorted(Php(lex(text)).program(), key=lambda e: e[1])
