"""C# 11."""

from __future__ import annotations

import re

from .base import END, HEAD, MIDDLE, NAME, NUMBER, PUNCT, STRING, TAIL, TEMPLATE, Parser, Tokens, remembered

_TOKEN = re.compile(
    r"(?:\s|﻿)*(?:"
    r"(@?[^\W\d]\w*)"
    r"|(0[xX][0-9a-fA-F_]+(?:[uU]?[lL]?|[lL][uU])|0[bB][01_]+(?:[uU]?[lL]?|[lL][uU])|(?:[0-9][0-9_]*(?:\.[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?(?:[fFdDmM]|[uU][lL]?|[lL][uU]?)?)"
    r"|(\$+\"{3,}|\"{3,}(?!\")|\$@\"|@\$\"|\$\"|@\"(?:[^\"]|\"\")*\"(?:u8)?|\"(?:[^\"\\\n\r]|\\[^\n\r])*\"(?:u8)?)"
    r"|('(?:[^'\\\n\r]|\\(?:[^\n\rxuU]|x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(//[^\n\r]*|/\*.*?\*/)"
    r"|(\#[^\n\r]*)"
    r"|(\?\?=|\?\?|=>|==|!=|<=|<<=|<<|->|\+\+|--|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|\.\.|[{}()\[\];,<>+\-*/%&|^!~?:=.])"
    r"|(\Z))",
    re.S,
)
_DIRECTIVES = frozenset("if elif else endif define undef region endregion pragma nullable error warning line".split())


@remembered
def lex(text: str) -> Tokens:
    """Tokens of a C# file; `>` stays single, directive lines are checked and left out."""
    out = Tokens(text)
    regions: list[str] = []
    _lex(text, 0, len(text), out, regions, False)
    for word in regions:
        out.errors.append((f"#{word} is not closed", len(text)))
    return out.close()


def _put(out: Tokens, kind: int, value: str, a: int, b: int) -> None:
    out.kinds.append(kind)
    out.values.append(value)
    out.starts.append(a)
    out.ends.append(b)
    out.newline.append(False)


def _lex(text: str, pos: int, stop: int, out: Tokens, regions: list[str], hole: bool) -> int:
    """Lex up to stop; in an interpolation hole, up to the brace that closes it."""
    token = _TOKEN.match
    level = 0
    while True:
        m = token(text, pos)
        if m is None:
            at = pos
            while at < stop and (text[at].isspace() or text[at] == "﻿"):
                at += 1
            if at >= stop:
                return stop
            c = text[at]
            if text.startswith("/*", at):
                out.errors.append(("unterminated comment", at))
                return stop
            if c == '"' or text.startswith('@"', at):
                out.errors.append(("unterminated string", at))
                line = text.find("\n", at)
                pos = stop if line < 0 or c == "@" else line
                _put(out, STRING, "", at, pos)
                continue
            out.errors.append((f"unexpected character {c!r}", at))
            pos = at + 1
            continue
        g = m.lastindex
        a, pos = m.span(g)
        if g == 1:
            _put(out, NAME, m[1], a, pos)
        elif g == 7:
            v = m[7]
            if v == "/" and text.startswith("/*", a):
                out.errors.append(("unterminated comment", a))
                return stop
            if hole:
                if v in ("(", "[", "{"):
                    level += 1
                elif v in (")", "]", "}"):
                    if not level and v == "}":
                        return a
                    level -= 1
                elif not level and (v == ":" or v == "::"):
                    return a
            _put(out, PUNCT, v, a, pos)
        elif g == 3:
            v = m[3]
            if v[0] in '"@' and v[-1] != "$" and len(v) > 1 and not v.startswith('"""') and v != '@$"':
                _put(out, STRING, v, a, pos)
            elif '"""' in v:
                quotes = '"' * v.count('"')
                end = text.find(quotes, pos)
                if end < 0:
                    out.errors.append(("unterminated string", a))
                    return stop
                pos = end + len(quotes)
                while text.startswith('"', pos):
                    pos += 1
                _put(out, STRING, "", a, pos)
            else:
                pos = _interpolated(text, a, pos, "@" in v, out, regions)
        elif g == 2:
            if text[pos : pos + 1].isalnum():
                out.errors.append(("malformed number", a))
            _put(out, NUMBER, m[2], a, pos)
        elif g == 5:
            out.comments.append((a, pos))
        elif g == 4:
            _put(out, STRING, m[4], a, pos)
        elif g == 6:
            line = text.rfind("\n", 0, a) + 1
            word = re.match(r"#\s*(\w*)", m[6])[1]
            if text[line:a].strip(" \t﻿") or word not in _DIRECTIVES:
                out.errors.append(("misplaced directive", a))
            elif word in ("if", "region"):
                regions.append(word)
            elif word in ("endif", "endregion"):
                if not regions or regions.pop() != word[3:]:
                    out.errors.append((f"stray #{word}", a))
            elif word in ("elif", "else") and (not regions or regions[-1] != "if"):
                out.errors.append((f"stray #{word}", a))
        else:
            return stop


def _interpolated(text: str, a: int, pos: int, verbatim: bool, out: Tokens, regions: list[str]) -> int:
    """An interpolated string from its opening quote on, as head, middle and tail tokens."""
    first = True
    start = a
    n = len(text)
    while pos < n:
        c = text[pos]
        if c == '"':
            if verbatim and text.startswith('""', pos):
                pos += 2
                continue
            _put(out, TEMPLATE if first else TAIL, "", start, pos + 1)
            return pos + 1
        if c == "\\" and not verbatim:
            pos += 2
        elif c == "{":
            if text.startswith("{{", pos):
                pos += 2
                continue
            _put(out, HEAD if first else MIDDLE, "", start, pos + 1)
            first = False
            pos = _lex(text, pos + 1, n, out, regions, True)
            if pos < n and text[pos] == ":":
                end = text.find("}", pos)
                quote = text.find('"', pos)
                if end < 0 or (0 <= quote < end):
                    break
                pos = end
            if pos >= n or text[pos] != "}":
                break
            start = pos
            pos += 1
        elif c == "}":
            if text.startswith("}}", pos):
                pos += 2
                continue
            out.errors.append(("stray brace in an interpolated string", pos))
            pos += 1
        elif c in "\n\r" and not verbatim:
            break
        else:
            pos += 1
    out.errors.append(("unterminated string", a))
    return pos


#: Reserved words of the language (fixed).
RESERVED = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
_BUILTIN = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
_MODIFIERS = frozenset("public private protected internal static readonly abstract sealed virtual override async extern unsafe volatile new partial const required file ref fixed".split())
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "<": 8, ">": 8, "<=": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "..": 13,
}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= ??=".split())
_AFTER_CAST = frozenset("( ~ !".split())
_QUERY = frozenset("from where select group into orderby join let in on equals by ascending descending".split())
VALUE, TARGET, TYPE = 0, 1, 2


class CSharp(Parser):
    resume = frozenset("public private protected internal class struct interface namespace using if for foreach while switch try return var throw lock".split())

    def __init__(self, tokens: Tokens):
        super().__init__(tokens)
        self.query = 0
        self.words = {
            "{": self.block, ";": self.empty, "if": self.if_, "while": self.while_, "do": self.do_, "for": self.for_, "foreach": self.foreach, "switch": self.switch,
            "try": self.try_, "return": self.return_, "break": self.simple, "continue": self.simple, "goto": self.goto, "throw": self.return_, "using": self.using_statement,
            "lock": self.while_, "fixed": self.fixed, "const": self.const_statement, "unsafe": self.block_after, "checked": self.checked, "unchecked": self.checked, "yield": self.yield_, "await": self.await_, "[": self.attributed,
        }

    # declarations

    def program(self) -> list[tuple[str, int]]:
        self.statements(self.top)
        return self.errors

    def top(self) -> None:
        p = self.p
        v = self.v[p]
        if v == "global" and self.v[p + 1] == "using":
            self.p = p + 1
            v = "using"
        if v == "using" and self.v[p + 1] != "(" and self.v[p + 1] != "var":
            if self.attempt(self.using):
                return
        if v == "extern" and self.v[p + 1] == "alias":
            self.p = p + 3
            self.need(";")
            return
        if v == "namespace":
            self.namespace()
            return
        if v == "[" and self.k[p] == PUNCT:
            self.attributes()
            if self.k[self.p] == END:
                return
        q = self.p
        while self.k[self.p] == NAME and self.v[self.p] in _MODIFIERS and self.v[self.p + 1] != "(":
            self.p += 1
        if self.k[self.p] == NAME and (self.v[self.p] in ("class", "struct", "interface", "enum", "delegate") or (self.v[self.p] == "record" and self.k[self.p + 1] == NAME)):
            self.type_declaration()
            return
        self.p = q
        self.statement()

    def using(self) -> None:
        self.p += 1
        self.take_word("static")
        if self.k[self.p] == NAME and self.v[self.p + 1] == "=":
            self.p += 2
        self.type()
        self.need(";")

    def namespace(self) -> None:
        self.p += 1
        self.dotted()
        if self.take(";"):
            return
        self.need("{")
        self.statements(self.top, "}")
        self.need("}")
        self.take(";")

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def name(self) -> None:
        if self.k[self.p] != NAME or self.v[self.p] in RESERVED:
            self.fail("expected a name")
        self.p += 1

    def attributes(self) -> None:
        while self.at("["):
            self.p += 1
            if self.k[self.p] == NAME and self.v[self.p + 1] == ":":
                self.p += 2
            while not self.take("]"):
                self.type(suffix=False)
                if self.at("("):
                    self.arguments()
                if not self.at("]"):
                    self.need(",")

    def type_declaration(self) -> None:
        kind = self.v[self.p]
        self.p += 1
        if kind == "delegate":
            self.type()
            self.name()
            self.type_parameters()
            self.parameters()
            self.constraints()
            self.need(";")
            return
        if kind == "record":
            if self.word("class") or self.word("struct"):
                self.p += 1
        self.name()
        if kind == "enum":
            if self.take(":"):
                self.type()
            self.need("{")
            while not self.take("}"):
                self.attributes()
                self.name()
                if self.take("="):
                    self.expression()
                if not self.at("}"):
                    self.need(",")
            self.take(";")
            return
        self.type_parameters()
        if self.at("("):
            self.parameters()
        if self.take(":"):
            self.type()
            if self.at("("):
                self.arguments()
            while self.take(","):
                self.type()
        self.constraints()
        if self.take(";"):
            return
        self.need("{")
        self.statements(self.member, "}")
        self.need("}")
        self.take(";")

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.attributes()
                if self.word("in") or self.word("out"):
                    self.p += 1
                self.name()
                if not self.take(","):
                    break
            self.need(">")

    def constraints(self) -> None:
        while self.word("where"):
            self.p += 1
            self.name()
            self.need(":")
            while True:
                if self.word("new") and self.v[self.p + 1] == "(":
                    self.p += 2
                    self.need(")")
                elif self.word("class") or self.word("struct") or self.word("default"):
                    self.p += 1
                    self.take("?")
                else:
                    self.type()
                if not self.take(","):
                    break

    def parameters(self, close: str = ")") -> None:
        self.need("(" if close == ")" else "[")
        while not self.take(close):
            self.attributes()
            while self.k[self.p] == NAME and self.v[self.p] in ("ref", "out", "in", "params", "this", "scoped", "readonly") and self.k[self.p + 1] in (NAME,):
                self.p += 1
            if self.at("("):
                self.type()
            else:
                self.type()
            self.name()
            if self.take("="):
                self.expression()
            if not self.at(close):
                self.need(",")

    def member(self) -> None:
        self.attributes()
        v, k = self.v, self.k
        p = self.p
        while k[self.p] == NAME and v[self.p] in _MODIFIERS and v[self.p + 1] not in ("(", "=", ";", ","):
            self.p += 1
        x = v[self.p]
        if k[self.p] == NAME:
            if x in ("class", "struct", "interface", "enum", "delegate") or (x == "record" and k[self.p + 1] == NAME and v[self.p + 2] in ("(", "{", ":", ";", "<", v[self.p + 2] if v[self.p + 1] in ("struct", "class") else "(")):
                self.type_declaration()
                return
            if x == "event":
                self.p += 1
                self.type()
                self.dotted()
                if self.take("{"):
                    self.accessors()
                    return
                if self.take("="):
                    self.expression()
                while self.take(","):
                    self.name()
                self.need(";")
                return
            if x in ("implicit", "explicit"):
                self.p += 1
                self.need_word("operator")
                self.take_word("checked")
                self.type()
                self.parameters()
                self.body()
                return
            if v[self.p + 1] == "(" and x not in RESERVED:
                self.p += 1
                self.parameters()
                if self.take(":"):
                    if not (self.word("base") or self.word("this")):
                        self.fail()
                    self.p += 1
                    self.arguments()
                self.body()
                return
        elif self.at("~"):
            self.p += 1
            self.name()
            self.parameters()
            self.body()
            return
        elif self.p > p and self.at("{"):
            self.fail()
        self.take_word("ref")
        self.type()
        if self.word("operator"):
            self.p += 1
            self.take_word("checked")
            while not self.at("("):
                if k[self.p] == END:
                    self.fail()
                self.p += 1
            self.parameters()
            self.body()
            return
        if self.word("this"):
            self.p += 1
            self.parameters("]")
            self.property_body()
            return
        self.name()
        while self.at(".") or self.at("<"):
            if self.at("<"):
                if self.attempt(self.type_parameters):
                    if not self.at("."):
                        break
                else:
                    self.type_arguments()
            else:
                self.p += 1
                if self.word("this"):
                    self.p += 1
                    self.parameters("]")
                    self.property_body()
                    return
                self.name()
        if self.at("("):
            self.parameters()
            self.constraints()
            self.body()
            return
        if self.at("{") or self.at("=>"):
            self.property_body()
            return
        self.declarators()
        self.need(";")

    def declarators(self) -> None:
        while True:
            if self.take("="):
                self.initialiser()
            if not self.take(","):
                return
            self.name()

    def initialiser(self) -> None:
        if self.at("{"):
            self.array_initialiser()
        else:
            self.take_word("ref")
            self.expression()

    def array_initialiser(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.initialiser()
            if not self.at("}"):
                self.need(",")

    def body(self) -> None:
        if self.take(";"):
            return
        if self.take("=>"):
            self.take_word("ref")
            self.expression()
            self.need(";")
            return
        self.block()

    def property_body(self) -> None:
        if self.take("=>"):
            self.take_word("ref")
            self.expression()
            self.need(";")
            return
        self.need("{")
        self.accessors()
        if self.take("="):
            self.initialiser()
            self.need(";")

    def accessors(self) -> None:
        some = False
        while not self.take("}"):
            self.attributes()
            while self.k[self.p] == NAME and self.v[self.p] in _MODIFIERS:
                self.p += 1
            if self.k[self.p] != NAME or self.v[self.p] not in ("get", "set", "init", "add", "remove"):
                self.fail("expected an accessor")
            self.p += 1
            self.body()
            some = True
        if not some:
            self.fail("expected an accessor")

    # types

    def type(self, suffix: bool = True) -> None:
        p = self.p
        if self.k[p] == NAME:
            v = self.v[p]
            if v in RESERVED and v not in _BUILTIN:
                self.fail("expected a type")
            self.p = p + 1
            if self.take("::"):
                self.name()
            while True:
                if self.at("<"):
                    self.type_arguments()
                if not self.at(".") or v in _BUILTIN:
                    break
                self.p += 1
                self.name()
        elif self.take("("):
            count = 0
            while True:
                self.type()
                count += 1
                if self.k[self.p] == NAME and self.v[self.p] not in RESERVED:
                    self.p += 1
                if not self.take(","):
                    break
            self.need(")")
            if count < 2:
                self.fail("expected a tuple")
        else:
            self.fail("expected a type")
        if not suffix:
            return
        while True:
            if self.at("?"):
                self.p += 1
            elif self.at("*"):
                self.p += 1
            elif self.at("[") and self.v[self.p + 1] in ("]", ","):
                q = self.p + 1
                while self.v[q] == "," and self.k[q] == PUNCT:
                    q += 1
                if self.v[q] != "]":
                    return
                self.p = q + 1
            else:
                return

    def type_arguments(self) -> None:
        self.need("<")
        if self.at(">") or self.at(","):
            while self.take(","):
                pass
            self.need(">")
            return
        while True:
            self.attributes()
            self.type()
            if not self.take(","):
                break
        self.need(">")

    # statements

    def block(self) -> None:
        self.need("{")
        query, self.query = self.query, 0
        self.statements(self.statement, "}")
        self.query = query
        self.take("}")

    def block_after(self) -> None:
        self.p += 1
        if self.at("{"):
            self.block()
        else:
            self.statement()

    def checked(self) -> None:
        if self.v[self.p + 1] == "(":
            self.expression_statement()
        else:
            self.block_after()

    def empty(self) -> None:
        self.p += 1

    def simple(self) -> None:
        self.p += 1
        self.need(";")

    def statement(self) -> None:
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == NAME or k == PUNCT:
            rule = self.words.get(v)
            if rule is not None:
                rule()
                return
            if k == NAME:
                if self.v[p + 1] == ":" and v not in RESERVED and self.k[p + 1] == PUNCT:
                    self.p = p + 2
                    self.statement()
                    return
                if v in ("static", "async", "ref", "readonly", "extern", "unsafe", "scoped") or self.declaration_ahead(p):
                    if self.attempt_declaration():
                        return
            elif v == "(" and self.match[p] > 0 and self.k[self.match[p] + 1] == NAME and self.attempt_declaration():
                return
        self.expression_statement()

    def declaration_ahead(self, p: int) -> bool:
        """Whether a type and a name may start here; rules out plain calls and assignments."""
        n = self.v[p + 1]
        if self.k[p + 1] == NAME:
            return n not in ("is", "as", "switch", "with") or self.v[p] in ("var",)
        if n == "(" or self.k[p + 1] != PUNCT:
            return False
        return n in ("<", "[", "?", ".", "*", "::")

    def attempt_declaration(self) -> bool:
        p, depth, errors = self.p, self.depth, len(self.errors)
        from .base import SyntaxFailure

        try:
            while self.k[self.p] == NAME and self.v[self.p] in ("static", "async", "ref", "readonly", "extern", "unsafe", "scoped"):
                self.p += 1
            self.type()
            if self.k[self.p] != NAME or self.v[self.p] in RESERVED:
                raise SyntaxFailure("", 0)
            self.p += 1
            x = self.v[self.p] if self.k[self.p] == PUNCT else ""
            if x not in ("=", ";", ",", "(", "<"):
                raise SyntaxFailure("", 0)
        except SyntaxFailure:
            self.p, self.depth = p, depth
            del self.errors[errors:]
            return False
        if x in ("(", "<"):
            self.type_parameters()
            self.parameters()
            self.constraints()
            self.body()
            return True
        self.declarators()
        self.need(";")
        return True

    def expression_statement(self) -> None:
        p = self.p
        kind = self.expression()
        if self.at(";"):
            self.p += 1
            last = self.v[self.p - 2]
            first = self.v[p]
            if kind == TARGET and not self.stepped and first not in ("await", "new") and last not in (")", "++", "--"):
                self.p = p
                self.fail("an expression that is no statement")
            return
        self.need(";")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def sub(self) -> None:
        p = self.p
        if self.word("const"):
            self.fail("a declaration as embedded statement")
        self.statement()
        if p == self.p:
            self.fail()

    def if_(self) -> None:
        self.p += 1
        self.condition()
        self.sub()
        if self.take_word("else"):
            self.sub()

    def while_(self) -> None:
        self.p += 1
        self.condition()
        self.sub()

    def do_(self) -> None:
        self.p += 1
        self.sub()
        self.need_word("while")
        self.condition()
        self.need(";")

    def for_(self) -> None:
        self.p += 1
        self.need("(")
        if not self.take(";"):
            if self.k[self.p] == NAME and self.declaration_ahead(self.p) and self.attempt(self.for_declaration):
                pass
            else:
                self.expression()
                while self.take(","):
                    self.expression()
            self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
            while self.take(","):
                self.expression()
        self.need(")")
        self.sub()

    def for_declaration(self) -> None:
        self.type()
        self.name()
        self.declarators()
        if not self.at(";"):
            self.fail()

    def foreach(self) -> None:
        self.p += 1
        self.need("(")
        self.take_word("ref")
        if self.word("var") and self.v[self.p + 1] == "(":
            self.p += 1
            self.designation()
        elif self.at("("):
            self.expression()
        else:
            self.type()
            self.name()
        self.need_word("in")
        self.expression()
        self.need(")")
        self.sub()

    def designation(self) -> None:
        if self.take("("):
            while True:
                self.designation()
                if not self.take(","):
                    break
            self.need(")")
        else:
            self.name()

    def switch(self) -> None:
        self.p += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take_word("case"):
                self.pattern()
                if self.take_word("when"):
                    self.expression()
            else:
                self.need_word("default")
            self.need(":")
            while not (self.at("}") or (self.k[self.p] == NAME and (self.v[self.p] == "case" or (self.v[self.p] == "default" and self.v[self.p + 1] == ":")))):
                if self.k[self.p] == END:
                    self.fail()
                self.statement()

    def try_(self) -> None:
        self.p += 1
        self.block()
        done = False
        while self.take_word("catch"):
            done = True
            if self.take("("):
                self.type()
                if self.k[self.p] == NAME:
                    self.name()
                self.need(")")
            if self.take_word("when"):
                self.condition()
            self.block()
        if self.take_word("finally"):
            done = True
            self.block()
        if not done:
            self.fail("expected catch or finally")

    def return_(self) -> None:
        self.p += 1
        if not self.at(";"):
            self.take_word("ref")
            self.expression()
        self.need(";")

    def goto(self) -> None:
        self.p += 1
        if self.take_word("case"):
            self.expression()
        elif not self.take_word("default"):
            self.name()
        self.need(";")

    def yield_(self) -> None:
        if self.v[self.p + 1] == "return":
            self.p += 2
            self.expression()
            self.need(";")
        elif self.v[self.p + 1] == "break":
            self.p += 2
            self.need(";")
        else:
            self.expression_statement()

    def await_(self) -> None:
        if self.v[self.p + 1] in ("foreach", "using"):
            self.p += 1
            self.statement()
        else:
            self.expression_statement()

    def using_statement(self) -> None:
        self.p += 1
        if self.take("("):
            if not self.attempt(self.using_declaration):
                self.expression()
            self.need(")")
            self.sub()
            return
        self.type()
        self.name()
        self.declarators()
        self.need(";")

    def using_declaration(self) -> None:
        self.type()
        self.name()
        self.need("=")
        self.initialiser()
        while self.take(","):
            self.name()
            self.need("=")
            self.initialiser()
        if not self.at(")"):
            self.fail()

    def fixed(self) -> None:
        self.p += 1
        self.need("(")
        self.using_declaration()
        self.need(")")
        self.sub()

    def const_statement(self) -> None:
        self.p += 1
        self.type()
        self.name()
        self.declarators()
        self.need(";")

    def attributed(self) -> None:
        self.attributes()
        self.statement()

    # patterns

    def pattern(self) -> None:
        self.pattern_and()
        while self.take_word("or"):
            self.pattern_and()

    def pattern_and(self) -> None:
        self.pattern_not()
        while self.take_word("and"):
            self.pattern_not()

    def pattern_not(self) -> None:
        while self.word("not"):
            self.p += 1
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == PUNCT and v in ("<", ">", "<=", ">=") :
            self.p += 1
            if v == ">":
                self.take("=")
            self.binary(9)
            return
        if k == PUNCT and v == "[":
            self.p += 1
            while not self.take("]"):
                if self.take(".."):
                    if not (self.at(",") or self.at("]")):
                        self.pattern()
                else:
                    self.pattern()
                if not self.at("]"):
                    self.need(",")
            self.optional_name()
            return
        if k == NAME and v == "var":
            self.p += 1
            self.designation()
            return
        if k == PUNCT and v == "{":
            self.property_pattern()
            return
        if k == PUNCT and v == "(":
            if not self.attempt(self.positional):
                self.binary(9)
            return
        if k == NAME and (v not in RESERVED or v in _BUILTIN) and self.attempt(self.type_pattern):
            return
        self.binary(9)

    def positional(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.k[self.p] == NAME and self.v[self.p + 1] == ":":
                self.p += 2
            self.pattern()
            if not self.at(")"):
                self.need(",")
        if self.at("{"):
            self.property_pattern()
        else:
            self.optional_name()
        self.pattern_end()

    def property_pattern(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.dotted()
            self.need(":")
            self.pattern()
            if not self.at("}"):
                self.need(",")
        self.optional_name()

    def optional_name(self) -> None:
        if self.k[self.p] == NAME and self.v[self.p] not in RESERVED and self.v[self.p] not in ("and", "or", "when", "is", "as", "switch", "with") and not (self.query and self.v[self.p] in _QUERY):
            self.p += 1

    def pattern_end(self) -> None:
        k, v = self.k[self.p], self.v[self.p]
        if k == PUNCT and v in (")", "]", "}", ",", ";", ":", "=>", "&&", "||", "?", "??", "==", "!=", "|", "&", "^"):
            return
        if k == NAME and (v in ("and", "or", "when") or (self.query and v in _QUERY)):
            return
        if k in (TAIL, MIDDLE):
            return
        self.fail()

    def type_pattern(self) -> None:
        p = self.p
        self.type()
        if self.v[self.p - 1] == "?" and self.k[self.p - 1] == PUNCT and self.k[self.p] not in (END,) and not (self.k[self.p] == PUNCT and self.v[self.p] in (")", ";", ",", "&&", "||", "}", "]")):
            self.p -= 1
        if self.at("("):
            self.positional()
        elif self.at("{"):
            self.property_pattern()
        else:
            self.optional_name()
        if p == self.p:
            self.fail()
        self.pattern_end()

    # expressions

    stepped = False

    def expression(self) -> int:
        kind = self.assign()
        return kind

    def assign(self) -> int:
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == NAME:
            q = p
            while self.v[q] in ("static", "async") and self.k[q + 1] in (NAME, PUNCT) and self.v[q + 1] in ("async", "static", "(", "delegate") or (self.v[q] in ("static", "async") and self.k[q + 1] == NAME and self.v[q + 2] == "=>"):
                q += 1
            if self.k[q] == NAME and self.v[q + 1] == "=>" and self.v[q] not in RESERVED:
                self.p = q + 2
                self.lambda_body()
                return VALUE
            if q > p and self.v[q] == "(":
                self.p = q
                self.lambda_()
                return VALUE
            if v == "from" and self.k[p + 1] == NAME and self.v[p + 1] not in RESERVED | {"is", "as"} and (self.v[p + 2] == "in" or self.k[p + 2] == NAME or self.v[p + 2] in ("<", ".", "[")) and self.v[p + 2] not in ("=",):
                self.query_()
                return VALUE
            if v == "throw":
                self.p = p + 1
                self.assign()
                return VALUE
            if v == "ref":
                self.p = p + 1
                return self.assign()
            if (v in _BUILTIN or v not in RESERVED) and self.k[p + 1] == PUNCT and self.v[p + 1] == "(":
                close = self.match[p + 1]
                if close > 0 and self.v[close + 1] == "=>" and v in _BUILTIN:
                    self.p = p + 1
                    self.lambda_()
                    return VALUE
        elif k == PUNCT and v == "(":
            close = self.match[p]
            if close > 0 and self.v[close + 1] == "=>" and self.k[close + 1] == PUNCT:
                if self.attempt(self.lambda_head):
                    self.lambda_body()
                    return VALUE
        kind = self.conditional()
        p = self.p
        if self.k[p] == PUNCT:
            v = self.v[p]
            if v in _ASSIGN:
                if kind == VALUE:
                    self.fail("invalid assignment target")
                self.p = p + 1
                self.take_word("ref")
                self.assign()
                self.stepped = False
                return VALUE
            if v == ">":
                n, starts = p + 1, self.tokens.starts
                while self.v[n] == ">" and starts[n] == starts[n - 1] + 1:
                    n += 1
                if n - p >= 2 and self.v[n] == "=" and starts[n] == starts[n - 1] + 1:
                    self.p = n + 1
                    self.assign()
                    return VALUE
        return kind

    def lambda_(self) -> None:
        self.lambda_head()
        self.lambda_body()

    def lambda_head(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.attributes()
            while self.k[self.p] == NAME and self.v[self.p] in ("ref", "out", "in", "params", "scoped"):
                self.p += 1
            if self.k[self.p] == NAME and self.v[self.p + 1] in (",", ")", "="):
                self.name()
            else:
                self.type()
                self.name()
            if self.take("="):
                self.expression()
            if not self.at(")"):
                self.need(",")
        self.need("=>")
        self.p -= 1

    def lambda_body(self) -> None:
        self.take("=>")
        if self.at("{"):
            self.block()
        else:
            self.take_word("ref")
            query, self.query = self.query, self.query
            self.assign()
            self.query = query

    def conditional(self) -> int:
        kind = self.binary(0)
        if self.k[self.p] == PUNCT and self.v[self.p] == "?":
            self.p += 1
            self.assign()
            self.need(":")
            self.assign()
            return VALUE
        return kind

    def binary(self, least: int) -> int:
        kind = self.unary()
        k, v = self.k, self.v
        starts = self.tokens.starts
        while True:
            p = self.p
            x = v[p]
            if k[p] == PUNCT:
                level = _BINARY.get(x)
                if level is None:
                    return kind
                step = 1
                if x == ">":
                    n = p + 1
                    while v[n] == ">" and k[n] == PUNCT and starts[n] == starts[n - 1] + 1:
                        n += 1
                    if v[n] == "=" and starts[n] == starts[n - 1] + 1:
                        if n - p > 1:
                            return kind
                        step = 2
                    elif n - p > 1:
                        step, level = n - p, 9
                if level <= least:
                    return kind
                self.p = p + step
                if x == "??":
                    if self.word("throw"):
                        self.p += 1
                    self.binary(0)
                elif x == "..":
                    if self.operand_ahead():
                        self.binary(level)
                else:
                    self.binary(level)
                kind = VALUE
            elif k[p] == NAME and x == "is":
                if least >= 8:
                    return kind
                self.p = p + 1
                self.pattern()
                kind = VALUE
            elif k[p] == NAME and x == "as":
                if least >= 8:
                    return kind
                self.p = p + 1
                self.type()
                if v[self.p - 1] == "?" and self.operand_ahead():
                    self.p -= 1
                kind = VALUE
            elif k[p] == NAME and x == "switch" and v[p + 1] == "{":
                self.p = p + 1
                self.switch_expression()
                kind = VALUE
            elif k[p] == NAME and x == "with" and v[p + 1] == "{":
                self.p = p + 1
                self.object_initialiser()
                kind = VALUE
            else:
                return kind

    def operand_ahead(self) -> bool:
        k, v = self.k[self.p], self.v[self.p]
        return k in (NUMBER, STRING, TEMPLATE, HEAD) or (k == NAME and v not in ("is", "as", "and", "or", "when")) or (k == PUNCT and v in ("(", "^", "-", "!"))

    def switch_expression(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.pattern()
            if self.take_word("when"):
                self.expression()
            self.need("=>")
            self.expression()
            if not self.at("}"):
                self.need(",")

    def unary(self) -> int:
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == PUNCT:
            if v in ("+", "-", "!", "~", "^", "&", "*"):
                self.p = p + 1
                self.unary()
                return TARGET if v == "*" else VALUE
            if v in ("++", "--"):
                self.p = p + 1
                if self.unary() == VALUE:
                    self.fail("invalid target")
                self.stepped = True
                return VALUE
            if v == "..":
                self.p = p + 1
                if self.operand_ahead():
                    self.binary(13)
                return VALUE
            if v == "(" and self.match[p] > 0:
                if self.cast_ahead(p) and self.attempt(self.cast):
                    self.unary()
                    return VALUE
        elif k == NAME and v == "await" and not (self.k[p + 1] == PUNCT and self.v[p + 1] not in ("(",)) and self.k[p + 1] != END:
            self.p = p + 1
            self.unary()
            return VALUE
        return self.postfix()

    def cast_ahead(self, p: int) -> bool:
        close = self.match[p]
        k, v = self.k[close + 1], self.v[close + 1]
        if self.v[p + 1] in _BUILTIN and self.k[p + 1] == NAME and self.v[p + 2] != ".":
            return True
        if self.k[p + 1] not in (NAME,) and self.v[p + 1] != "(":
            return False
        return k in (NUMBER, STRING, TEMPLATE, HEAD) or (k == NAME and v not in ("is", "as", "switch", "with", "and", "or", "when") and not (self.query and v in _QUERY)) or (k == PUNCT and v in _AFTER_CAST and v != "!" or v == "!" and self.v[close + 2] != "=")

    def cast(self) -> None:
        self.need("(")
        self.type()
        self.need(")")

    def postfix(self) -> int:
        self.stepped = False
        kind = self.primary()
        k, v = self.k, self.v
        while True:
            p = self.p
            if k[p] != PUNCT:
                return kind
            x = v[p]
            if x == "." or x == "->" or x == "::":
                self.p = p + 1
                if k[self.p] != NAME or v[self.p] in RESERVED:
                    self.fail("expected a name")
                self.p += 1
                kind = TARGET
                if self.at("<"):
                    self.attempt(self.generic)
            elif x == "?" and (v[p + 1] == "." or (v[p + 1] == "[" and self.conditional_index(p))):
                self.p = p + 1
                kind = TARGET
            elif x == "(":
                self.arguments()
                kind = VALUE
                self.stepped = True
            elif x == "[":
                self.p = p + 1
                while not self.take("]"):
                    if k[self.p] == NAME and v[self.p + 1] == ":":
                        self.p += 2
                    self.expression()
                    if not self.at("]"):
                        self.need(",")
                kind = TARGET
            elif x == "++" or x == "--":
                if kind == VALUE:
                    self.fail("invalid target")
                self.p = p + 1
                self.stepped = True
                kind = VALUE
            elif x == "!" and not (v[p + 1] == "=" and self.tokens.starts[p + 1] == self.tokens.starts[p] + 1):
                self.p = p + 1
            else:
                return kind

    def conditional_index(self, p: int) -> bool:
        close = self.match[p + 1]
        return close > 0 and v_not_colon(self, close + 1)

    def generic(self) -> None:
        self.type_arguments()
        k, v = self.k[self.p], self.v[self.p]
        if not (k == PUNCT and v in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "|", "^", "&&", "||", "&", "[", "=>") or k in (END, TAIL, MIDDLE)):
            self.fail()

    def arguments(self) -> None:
        self.need("(")
        query, self.query = self.query, 0
        k, v = self.k, self.v
        while not self.take(")"):
            if k[self.p] == NAME and v[self.p + 1] == ":" and k[self.p + 1] == PUNCT:
                self.p += 2
            self.argument()
            if not self.at(")"):
                self.need(",")
                if self.at(")"):
                    self.fail()
        self.query = query

    def argument(self) -> None:
        if self.k[self.p] == NAME and self.v[self.p] in ("ref", "out", "in") and self.k[self.p + 1] in (NAME, PUNCT):
            out = self.v[self.p] == "out"
            self.p += 1
            if out and self.attempt(self.out_declaration):
                return
        self.expression()

    def out_declaration(self) -> None:
        if self.word("var") and self.v[self.p + 1] == "(":
            self.p += 1
            self.designation()
            return
        self.type()
        self.name()

    def interpolation(self) -> None:
        p = self.p
        if self.k[p] == TEMPLATE:
            self.p = p + 1
            return
        self.p = p + 1
        while True:
            self.expression()
            if self.take(","):
                self.expression()
            k = self.k[self.p]
            if k == MIDDLE:
                self.p += 1
            elif k == TAIL:
                self.p += 1
                break
            else:
                self.fail()

    def primary(self) -> int:
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == NAME:
            if v not in RESERVED:
                self.p = p + 1
                if v == "nameof" or self.v[p + 1] == "(":
                    return TARGET
                if v == "var" and self.k[self.p] == NAME or (v == "var" and self.at("(")):
                    self.designation()
                    return TARGET
                if self.at("<"):
                    self.attempt(self.generic)
                return TARGET
            if v in ("this", "base"):
                self.p = p + 1
                return VALUE if v == "base" else TARGET
            if v in ("null", "true", "false"):
                self.p = p + 1
                return VALUE
            if v == "default":
                self.p = p + 1
                if self.take("("):
                    self.type()
                    self.need(")")
                return VALUE
            if v in ("typeof", "sizeof"):
                self.p = p + 1
                self.need("(")
                self.type()
                self.need(")")
                return VALUE
            if v in ("checked", "unchecked"):
                self.p = p + 1
                self.condition()
                return VALUE
            if v == "new":
                return self.new()
            if v == "stackalloc":
                self.p = p + 1
                if not self.at("["):
                    self.type(suffix=False)
                self.need("[")
                if not self.at("]"):
                    self.expression()
                self.need("]")
                if self.at("{"):
                    self.array_initialiser()
                return VALUE
            if v == "delegate":
                self.p = p + 1
                if self.at("("):
                    self.parameters()
                self.block()
                return VALUE
            if v in _BUILTIN and self.v[p + 1] in (".", "?", "["):
                self.p = p + 1
                return VALUE
            self.fail()
        if k == NUMBER or k == STRING:
            self.p = p + 1
            return VALUE
        if k == TEMPLATE or k == HEAD:
            self.interpolation()
            return VALUE
        if k == PUNCT and v == "(":
            self.p = p + 1
            query, self.query = self.query, 0
            kind = VALUE
            count = 0
            while True:
                if self.k[self.p] == NAME and self.v[self.p + 1] == ":" and self.k[self.p + 1] == PUNCT:
                    self.p += 2
                if self.k[self.p] == NAME and self.k[self.p + 1] == NAME and self.v[self.p + 1] not in ("is", "as", "switch", "with") and self.attempt(self.tuple_declaration):
                    kind = TARGET
                else:
                    kind = self.expression()
                count += 1
                if not self.take(","):
                    break
            self.query = query
            self.need(")")
            return TARGET if count > 1 else kind
        self.fail()
        return VALUE

    def tuple_declaration(self) -> None:
        self.type()
        self.name()
        if not (self.at(",") or self.at(")")):
            self.fail()

    def new(self) -> int:
        self.p += 1
        if self.take("("):
            self.p -= 1
            self.arguments()
            if self.at("{"):
                self.object_initialiser()
            self.stepped = True
            return VALUE
        if self.at("{"):
            self.anonymous()
            return VALUE
        if self.at("["):
            self.p += 1
            while self.take(","):
                pass
            self.need("]")
            self.array_initialiser()
            return VALUE
        self.type(suffix=False)
        self.take("?")
        if self.at("["):
            while self.at("["):
                self.p += 1
                while not self.take("]"):
                    if not self.take(","):
                        self.expression()
                if self.at("?"):
                    break
            if self.at("{"):
                self.array_initialiser()
            return VALUE
        done = False
        if self.at("("):
            self.arguments()
            done = True
        if self.at("{"):
            self.object_initialiser()
            done = True
        if not done:
            self.fail()
        self.stepped = True
        return VALUE

    def anonymous(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.k[self.p] == NAME and self.v[self.p + 1] == "=" and self.k[self.p + 1] == PUNCT:
                self.p += 2
            self.expression()
            if not self.at("}"):
                self.need(",")

    def object_initialiser(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.at("{"):
                self.array_initialiser()
            elif self.at("["):
                self.p += 1
                while not self.take("]"):
                    self.expression()
                    if not self.at("]"):
                        self.need(",")
                self.need("=")
                self.member_value()
            elif self.k[self.p] == NAME and self.v[self.p + 1] == "=" and self.k[self.p + 1] == PUNCT:
                self.p += 2
                self.member_value()
            else:
                self.expression()
            if not self.at("}"):
                self.need(",")

    def member_value(self) -> None:
        if self.at("{"):
            self.object_initialiser()
        else:
            self.expression()

    def query_(self) -> None:
        self.query += 1
        try:
            self.query_from()
            while True:
                v = self.v[self.p] if self.k[self.p] == NAME else ""
                if v == "from":
                    self.query_from()
                elif v == "where":
                    self.p += 1
                    self.expression()
                elif v == "let":
                    self.p += 1
                    self.name()
                    self.need("=")
                    self.expression()
                elif v == "join":
                    self.p += 1
                    if self.v[self.p + 1] != "in":
                        self.type()
                    self.name()
                    self.need_word("in")
                    self.expression()
                    self.need_word("on")
                    self.expression()
                    self.need_word("equals")
                    self.expression()
                    if self.take_word("into"):
                        self.name()
                elif v == "orderby":
                    self.p += 1
                    while True:
                        self.expression()
                        if self.word("ascending") or self.word("descending"):
                            self.p += 1
                        if not self.take(","):
                            break
                elif v in ("select", "group"):
                    self.p += 1
                    self.expression()
                    if v == "group":
                        self.need_word("by")
                        self.expression()
                    if not self.take_word("into"):
                        return
                    self.name()
                else:
                    self.fail()
        finally:
            self.query -= 1

    def query_from(self) -> None:
        self.p += 1
        if self.v[self.p + 1] != "in":
            self.type()
        self.name()
        self.need_word("in")
        self.expression()


def v_not_colon(parser: CSharp, p: int) -> bool:
    """Whether what follows an index rules out a conditional expression."""
    return not (parser.k[p] == PUNCT and parser.v[p] == ":")


def parse(text: str) -> list[tuple[str, int]]:
    """All syntax errors of a C# file as (message, offset), the first cause first."""
    return sorted(CSharp(lex(text)).program(), key=lambda e: e[1])
