"""JavaScript (ES2022, module or CommonJS) and TypeScript 5."""

from __future__ import annotations

import re

from .base import ELEMENT, END, HEAD, MIDDLE, NAME, NUMBER, PRIVATE, PUNCT, REGEX, STRING, TAIL, TEMPLATE, Parser, SyntaxFailure, Tokens, remembered

_SPACE = r"[^\S\n\r\u2028\u2029]|\ufeff"
_TOKEN = re.compile(
    rf"(?:{_SPACE})*([\n\r\u2028\u2029](?:\s|\ufeff)*)?(?:"
    r"((?:[^\W\d]|[$]|\\u[0-9a-fA-F{{]+\}}?)(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F{{]+\}}?)*)"
    r"|(0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*n|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?))"
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"
    r"|(//[^\n\r]*|/\*.*?\*/|<!--[^\n\r]*)"
    r"|(/)|(`)"
    r"|(\.\.\.|=>|===|!==|\*\*=|\*\*|==|!=|<<=|<=|<<|>>>=|>>=|>>>|>=|>>|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|[{{}}()\[\];,<>+\-*%&|^!~?:=.@])"
    r"|(\#(?:[^\W\d]|[$])[\w$]*)"
    r"|(\Z))".replace("{{", "{").replace("}}", "}"),
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=|extends\s+[^/>=\s])")
_BEFORE_REGEX = frozenset(
    "return typeof instanceof in of new delete void throw case do else await yield default extends".split()
)


@remembered
def lex(text: str, ts: bool, elements: bool = False) -> Tokens:
    """Tokens of a script. Comments are kept apart; `>` stays single in TypeScript; an element is one token."""
    return _lex(text, ts, elements, 0, False)[0]


def _lex(text: str, ts: bool, elements: bool, begin: int, inside: bool) -> tuple[Tokens, int]:
    """Tokens from an offset on, inside an element up to the brace that closes the expression, and where they end."""
    out = Tokens(text)
    kinds, values, starts, ends, newline = out.kinds, out.values, out.starts, out.ends, out.newline
    token = _TOKEN.match
    pos = begin
    if not begin and text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else len(text)
    fresh = True
    braces: list[int] = []
    level = 0
    while True:
        m = token(text, pos)
        if m is None:
            at = pos
            while at < len(text) and (text[at].isspace() or text[at] == "\ufeff"):
                at += 1
            if text.startswith("/*", at):
                out.errors.append(("unterminated comment", at))
                break
            if text[at] in "\"'":
                out.errors.append(("unterminated string", at))
                line = text.find("\n", at)
                pos = len(text) if line < 0 else line
                kinds.append(STRING)
                values.append("")
                starts.append(at)
                ends.append(pos)
                newline.append(True)
                continue
            out.errors.append((f"unexpected character {text[at]!r}", at))
            pos = at + 1
            continue
        g = m.lastindex
        if m.start(1) >= 0:
            fresh = True
        a = m.start(g)
        pos = m.end()
        if g == 2:
            kind = NAME
            value = m[2]
        elif g == 8:
            kind = PUNCT
            value = m[8]
            if value == "{":
                level += 1
            elif value == "}":
                if braces and braces[-1] == level:
                    t = _TEMPLATE.match(text, pos)
                    if t is None:
                        out.errors.append(("unterminated template", a))
                        break
                    pos = t.end()
                    if t[1] == "`":
                        kind = TAIL
                        braces.pop()
                        level -= 1
                    else:
                        kind = MIDDLE
                    value = ""
                else:
                    if inside and not level:
                        return out.close(a), a
                    level -= 1
            elif value == "<" and elements and not _after_value(kinds, values, fresh) and not (ts and _GENERIC.match(text, a)):
                pos = _element(out, text, ts, a)
                kind, value = ELEMENT, ""
            elif ts and value[0] == ">" and len(value) > 1 and value != ">=":
                pos = a + 1
                value = ">"
        elif g == 3:
            kind = NUMBER
            value = m[3]
            if text[pos : pos + 1].isalnum() or (value[-1] == "_" or "__" in value):
                out.errors.append(("malformed number", a))
        elif g == 4:
            kind = STRING
            value = m[4]
        elif g == 5:
            out.comments.append((a, pos))
            if "\n" in m[5]:
                fresh = True
            continue
        elif g == 6:
            if text.startswith("/*", a):
                out.errors.append(("unterminated comment", a))
                break
            division = _after_value(kinds, values, fresh)
            r = None if division else _REGEX.match(text, a)
            if r is None and not division:
                out.errors.append(("unterminated regular expression", a))
                line = text.find("\n", a)
                pos = len(text) if line < 0 else line
                kind, value = REGEX, ""
            elif r is not None:
                kind, value, pos = REGEX, "/", r.end()
                if not set(r[1]) <= set("dgimsuyv") or len(set(r[1])) < len(r[1]):
                    out.errors.append(("invalid regular expression flags", a))
            else:
                kind = PUNCT
                value = "/=" if text.startswith("/=", a) else "/"
                pos = a + len(value)
        elif g == 7:
            t = _TEMPLATE.match(text, pos)
            if t is None:
                out.errors.append(("unterminated template", a))
                break
            pos = t.end()
            value = ""
            if t[1] == "`":
                kind = TEMPLATE
            else:
                kind = HEAD
                level += 1
                braces.append(level)
        elif g == 9:
            kind = PRIVATE
            value = m[9]
        else:
            break
        kinds.append(kind)
        values.append(value)
        starts.append(a)
        ends.append(pos)
        newline.append(fresh)
        fresh = False
    if inside:
        out.errors.append(("expected '}', found end of file", len(text)))
    return out.close(), len(text)


def _after_value(kinds: list[int], values: list[str], fresh: bool) -> bool:
    """Whether what was read last can end an operand, so that no operand begins here."""
    if not kinds:
        return False
    before, last = kinds[-1], values[-1]
    return (
        before in (NUMBER, STRING, TEMPLATE, TAIL, REGEX, PRIVATE, ELEMENT)
        or (before == NAME and (last not in _BEFORE_REGEX or (len(values) > 1 and values[-2] == ".")))
        or (before == PUNCT and last in (")", "]", "}", "++", "--") and not (last == "}" and fresh))
    )


def _element(out: Tokens, text: str, ts: bool, pos: int) -> int:
    """Read the element at an offset with all within it; returns where it ends.

    Expressions in braces are read as scripts of their own and kept with the
    tokens, to be parsed in the place of the element.
    """
    n = len(text)
    open_: list[str] = []

    def blank(at: int) -> int:
        while at < n and (text[at].isspace() or text.startswith(("/*", "//"), at)):
            if text[at].isspace():
                at += 1
            else:
                end = text.find("*/" if text[at + 1] == "*" else "\n", at + 2)
                at = n if end < 0 else end + 2 - (text[at + 1] != "*")
        return at

    def braces(at: int) -> int:
        tokens, end = _lex(text, ts, True, at + 1, True)
        out.inner.append(tokens)
        out.comments += tokens.comments
        return min(end + 1, n)

    while True:
        # at a tag
        start = pos
        pos = blank(pos + 1)
        closing = text.startswith("/", pos)
        if closing:
            pos = blank(pos + 1)
        tag = _TAG.match(text, pos)
        name = tag[0] if tag else ""
        pos = blank(tag.end() if tag else pos)
        if closing:
            if not text.startswith(">", pos) or not open_ or open_[-1] != name:
                out.errors.append((f"unexpected closing tag </{name}>", start))
                return min(pos + 1, n)
            open_.pop()
            pos += 1
        else:
            if name and ts and text.startswith("<", pos):
                end = text.find(">", pos)
                pos = blank(n if end < 0 else end + 1)
            while name and pos < n and text[pos] not in "/>":
                if text[pos] == "{":
                    pos = blank(braces(pos))
                    continue
                attribute = _TAG.match(text, pos)
                if attribute is None:
                    out.errors.append((f"unexpected {text[pos]!r} in a tag", pos))
                    return pos + 1
                pos = blank(attribute.end())
                if text.startswith("=", pos):
                    pos = blank(pos + 1)
                    if text.startswith("{", pos):
                        pos = blank(braces(pos))
                    elif text.startswith(("'", '"'), pos):
                        end = text.find(text[pos], pos + 1)
                        pos = blank(n if end < 0 else end + 1)
                    else:
                        out.errors.append(("expected the value of an attribute", pos))
                        return pos + 1
            if text.startswith("/>", pos) and name:
                pos += 2
            elif text.startswith(">", pos):
                pos += 1
                open_.append(name)
            else:
                out.errors.append(("malformed tag", start))
                return min(pos + 1, n)
        while open_:
            # between tags
            while pos < n and text[pos] not in "<{>}":
                pos += 1
            if pos >= n:
                out.errors.append((f"<{open_[-1]}> is not closed", start))
                return n
            if text[pos] == "{":
                pos = braces(pos)
                continue
            if text[pos] == "<":
                break
            out.errors.append((f"unexpected {text[pos]!r} in an element", pos))
            pos += 1
        if not open_:
            return pos


RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset("! ~ + -".split())
_PREFIX_WORDS = frozenset("typeof void delete".split())
_MODIFIERS = frozenset("public private protected readonly abstract override declare static async accessor".split())
_KEYWORD_TYPES = frozenset("any unknown never void string number boolean object symbol bigint undefined null this true false".split())
#: What an expression gives: no target, a simple target, a literal that may be a pattern.
VALUE, TARGET, PATTERN = 0, 1, 2


class Ecma(Parser):
    resume = frozenset(
        "function class const let var if for while do switch try return throw import export interface type enum namespace break continue async".split()
    )

    def __init__(self, tokens: Tokens, ts: bool):
        super().__init__(tokens)
        self.ts = ts
        self.function = 0
        self.loops = 0
        self.switches = 0
        self.is_async = True
        self.generator = False
        self.module = False
        self.top_return = -1
        self.labels: list[str] = []
        self.cover = -1
        self.no_in = False
        self.ambient = False
        self.words = {
            "{": self.block, ";": self.empty, "var": self.variables, "const": self.const, "function": self.function_statement, "class": self.class_statement,
            "if": self.if_, "for": self.for_, "while": self.while_, "do": self.do_, "return": self.return_, "break": self.break_, "continue": self.continue_,
            "throw": self.throw, "try": self.try_, "switch": self.switch, "import": self.import_, "export": self.export, "debugger": self.simple, "with": self.with_, "@": self.decorated,
        }
        self.soft = {"let": self.let, "async": self.async_}
        if ts:
            self.soft |= {"type": self.alias, "interface": self.interface, "enum": self.enum, "namespace": self.namespace, "module": self.namespace, "declare": self.declare, "abstract": self.abstract, "global": self.global_}

    def program(self) -> list[tuple[str, int]]:
        self.statements(self.statement)
        if self.module and self.top_return >= 0:
            self.errors.append(("return outside a function", self.top_return))
        return self.errors

    def contained(self) -> list[tuple[str, int]]:
        """The expression in the braces of an element; it may be missing, spread, and wait or yield as its place allows."""
        self.generator = True
        try:
            if self.k[0] != END:
                self.take("...")
                self.expression()
                if self.k[self.p] != END:
                    self.fail()
        except SyntaxFailure as e:
            self.keep(e)
        return self.errors

    # statements

    def statement(self) -> None:
        p = self.p
        v = self.v[p]
        k = self.k[p]
        if k == NAME or k == PUNCT:
            rule = self.words.get(v)
            if rule is not None and (v != "import" or self.v[p + 1] not in ("(", ".")):
                self.depth += 1
                rule()
                self.depth -= 1
                return
            if k == NAME:
                rule = self.soft.get(v)
                if rule is not None and rule() is not False:
                    return
                if self.v[p + 1] == ":" and self.k[p + 1] == PUNCT and v not in RESERVED:
                    self.p = p + 2
                    self.labels.append(v)
                    try:
                        self.statement()
                    finally:
                        self.labels.pop()
                    return
        self.expression()
        self.semicolon()

    def semicolon(self) -> None:
        p = self.p
        if self.k[p] == PUNCT:
            if self.v[p] == ";":
                self.p = p + 1
                return
            if self.v[p] == "}":
                return
        if not self.nl[p]:
            self.fail()

    def empty(self) -> None:
        self.p += 1

    def simple(self) -> None:
        self.p += 1
        self.semicolon()

    def block(self) -> None:
        self.need("{")
        self.statements(self.statement, "}")
        self.take("}")

    def variables(self) -> None:
        self.p += 1
        self.declarators(False)
        self.semicolon()

    def const(self) -> None:
        if self.ts and self.v[self.p + 1] == "enum":
            self.p += 1
            self.enum()
            return
        self.p += 1
        self.declarators(not self.ambient)
        self.semicolon()

    def let(self):
        p = self.p + 1
        if self.k[p] == NAME and self.v[p] not in ("in", "of", "instanceof") or self.v[p] in ("[", "{"):
            self.p = p
            self.declarators(False)
            self.semicolon()
            return None
        return False

    def declarators(self, initialised: bool) -> None:
        while True:
            pattern = self.binding()
            if self.ts:
                if self.at("!"):
                    self.p += 1
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assign()
            elif (initialised or (pattern and not self.ambient)):
                self.fail("missing initialiser")
            if not self.take(","):
                return

    def binding(self) -> bool:
        """A binding name or pattern; tells whether it is a pattern."""
        p = self.p
        if self.k[p] == NAME:
            if self.v[p] in RESERVED and not (self.ts and self.v[p] == "this"):
                self.fail()
            self.p = p + 1
            return False
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.assign_in()
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.binding()
                else:
                    named = self.k[self.p] == NAME and self.v[self.p] not in RESERVED
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not named:
                        self.fail()
                    if self.take("="):
                        self.assign_in()
                if not self.at("}"):
                    self.need(",")
        else:
            self.fail()
        return True

    def assign_in(self) -> None:
        no_in, self.no_in = self.no_in, False
        self.assign()
        self.no_in = no_in

    def property_name(self) -> None:
        k = self.k[self.p]
        if k in (NAME, STRING, NUMBER):
            self.p += 1
        elif self.take("["):
            self.assign_in()
            self.need("]")
        else:
            self.fail()

    def function_statement(self) -> None:
        self.p += 1
        self.function_rest(False, named=True)

    def async_(self):
        if self.v[self.p + 1] == "function" and not self.nl[self.p + 1]:
            self.p += 2
            self.function_rest(True, named=True)
            return None
        return False

    def function_rest(self, is_async: bool, named: bool, body: bool = True) -> None:
        """After the word function."""
        star = self.take("*")
        if self.k[self.p] == NAME and self.v[self.p] not in RESERVED:
            self.p += 1
        elif named:
            self.fail("expected a function name")
        self.signature()
        self.body(is_async, star, optional=self.ts and named)

    def signature(self) -> None:
        if self.ts and self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.ts and self.take(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            while self.at("@"):
                self.decorator()
            if self.ts:
                while self.k[self.p] == NAME and self.v[self.p] in _MODIFIERS and (self.k[self.p + 1] == NAME or self.v[self.p + 1] in ("{", "[")):
                    self.p += 1
            rest = self.take("...")
            self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                if rest:
                    self.fail("a rest parameter has no default")
                self.assign_in()
            if not self.at(")"):
                if rest:
                    self.fail("a rest parameter must be last")
                self.need(",")

    def body(self, is_async: bool, generator: bool, optional: bool = False) -> None:
        if optional and not self.at("{"):
            self.semicolon()
            return
        saved = self.function, self.loops, self.switches, self.is_async, self.generator, self.labels, self.no_in
        self.function, self.loops, self.switches, self.is_async, self.generator, self.labels, self.no_in = 1, 0, 0, is_async, generator, [], False
        try:
            self.depth += 1
            self.block()
            self.depth -= 1
        finally:
            self.function, self.loops, self.switches, self.is_async, self.generator, self.labels, self.no_in = saved

    def class_statement(self) -> None:
        self.p += 1
        if self.k[self.p] == NAME and self.v[self.p] not in RESERVED:
            self.p += 1
        else:
            self.fail("expected a class name")
        self.class_rest()

    def class_rest(self) -> None:
        if self.ts and self.at("<"):
            self.type_parameters()
        if self.take_word("extends"):
            self.postfix()
            if self.ts and self.at("<"):
                self.type_arguments()
        if self.ts and self.take_word("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        self.statements(self.member, "}")
        self.need("}")

    def member(self) -> None:
        if self.take(";"):
            return
        while self.at("@"):
            self.decorator()
        v, k = self.v, self.k
        if v[self.p] == "static" and v[self.p + 1] == "{" and k[self.p] == NAME:
            self.p += 1
            self.body(False, False)
            return
        is_async = accessor = abstract = False
        while k[self.p] == NAME:
            x = v[self.p]
            n = self.p + 1
            follows = k[n] in (NAME, STRING, NUMBER, PRIVATE) or v[n] == "[" or (v[n] == "*" and x in ("async", "static"))
            if not follows:
                break
            if x == "async":
                if self.nl[n]:
                    break
                is_async = True
            elif x in ("get", "set"):
                if self.nl[n] and self.ts is False and k[n] != NAME:
                    break
                accessor = True
            elif x in ("static", "accessor") or (self.ts and x in _MODIFIERS):
                abstract |= x in ("abstract", "declare")
            else:
                break
            self.p = n
            if accessor:
                break
        star = self.take("*")
        if self.ts and self.at("["):
            if self.attempt(self.index_signature):
                self.semicolon()
                return
        if k[self.p] == PRIVATE:
            self.p += 1
        else:
            self.property_name()
        if self.ts and (self.at("?") or self.at("!")):
            self.p += 1
        if self.at("(") or (self.ts and self.at("<")):
            self.signature()
            self.body(is_async, star, optional=self.ts)
            return
        if star or is_async or accessor:
            self.fail()
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            saved, self.function = self.function, 1
            self.assign()
            self.function = saved
        self.semicolon()

    def index_signature(self) -> None:
        self.need("[")
        self.p += 1
        self.need(":")
        self.type()
        self.need("]")
        if self.take(":"):
            self.type()

    def decorator(self) -> None:
        self.need("@")
        if self.at("("):
            self.group()
            return
        self.name()
        while self.take("."):
            self.p += 1
        if self.ts and self.at("<"):
            self.type_arguments()
        while self.at("("):
            self.arguments()

    def decorated(self) -> None:
        while self.at("@"):
            self.decorator()
        v = self.v[self.p]
        if v not in ("class", "export", "abstract"):
            self.fail()
        self.depth -= 1
        self.statement()
        self.depth += 1

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.p += 1
        self.condition()
        self.sub()
        if self.take_word("else"):
            self.sub()

    def sub(self) -> None:
        v = self.v[self.p]
        if self.k[self.p] == NAME and (v in ("class", "const", "import", "export") or (v == "let" and self.v[self.p + 1] == "[")):
            self.fail()
        self.statement()

    def loop_body(self) -> None:
        self.loops += 1
        try:
            self.sub()
        finally:
            self.loops -= 1

    def while_(self) -> None:
        self.p += 1
        self.condition()
        self.loop_body()

    def with_(self) -> None:
        self.p += 1
        self.condition()
        self.sub()

    def do_(self) -> None:
        self.p += 1
        self.loop_body()
        self.need_word("while")
        self.condition()
        self.take(";")

    def for_(self) -> None:
        self.p += 1
        if self.take_word("await") and not self.is_async:
            self.fail()
        self.need("(")
        declared = False
        if not self.at(";"):
            v = self.v[self.p]
            self.no_in = True
            try:
                if self.k[self.p] == NAME and (v in ("var", "const") or (v == "let" and (self.k[self.p + 1] == NAME or self.v[self.p + 1] in ("[", "{")))):
                    declared = True
                    self.p += 1
                    pattern = self.binding()
                    if self.ts and self.take(":"):
                        self.type()
                    if not (self.word("of") or self.word("in")):
                        if self.take("="):
                            self.assign()
                        elif pattern or v == "const":
                            self.fail("missing initialiser")
                        if self.take(","):
                            self.declarators(v == "const")
                else:
                    kind = self.expression()
                    if (self.word("of") or self.word("in")) and kind == VALUE:
                        self.fail("invalid loop target")
            finally:
                self.no_in = False
            if self.take_word("of"):
                self.cover = -1
                self.assign()
                self.need(")")
                self.loop_body()
                return
            if self.take_word("in"):
                self.cover = -1
                self.expression()
                self.need(")")
                self.loop_body()
                return
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.loop_body()

    def return_(self) -> None:
        if not self.function and self.top_return < 0:
            self.top_return = self.tokens.starts[self.p]
        self.p += 1
        p = self.p
        if not self.nl[p] and not (self.k[p] == PUNCT and self.v[p] in (";", "}")) and self.k[p] != END:
            self.expression()
        self.semicolon()

    def break_(self) -> None:
        self.p += 1
        if self.k[self.p] == NAME and not self.nl[self.p]:
            if self.v[self.p] not in self.labels:
                self.fail("undefined label")
            self.p += 1
        elif not self.loops and not self.switches:
            self.p -= 1
            self.fail("break outside a loop")
        self.semicolon()

    def continue_(self) -> None:
        self.p += 1
        if self.k[self.p] == NAME and not self.nl[self.p]:
            if self.v[self.p] not in self.labels:
                self.fail("undefined label")
            self.p += 1
        if not self.loops:
            self.p -= 1
            self.fail("continue outside a loop")
        self.semicolon()

    def throw(self) -> None:
        self.p += 1
        if self.nl[self.p]:
            self.fail("line break after throw")
        self.expression()
        self.semicolon()

    def try_(self) -> None:
        self.p += 1
        self.block()
        done = False
        if self.take_word("catch"):
            done = True
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take_word("finally"):
            done = True
            self.block()
        if not done:
            self.fail("expected catch or finally")

    def switch(self) -> None:
        self.p += 1
        self.condition()
        self.need("{")
        self.switches += 1
        default = False
        try:
            while not self.take("}"):
                if self.take_word("case"):
                    self.expression()
                else:
                    self.need_word("default")
                    if default:
                        self.fail("more than one default")
                    default = True
                self.need(":")
                while not (self.at("}") or self.word("case") or (self.word("default"))):
                    if self.k[self.p] == END:
                        self.fail()
                    self.statement()
        finally:
            self.switches -= 1

    def import_(self) -> None:
        if self.depth > 1:
            self.fail("import inside a block")
        self.module = True
        self.p += 1
        if self.k[self.p] == STRING:
            self.p += 1
            self.attributes()
            self.semicolon()
            return
        if self.ts and self.word("type") and (self.k[self.p + 1] == NAME and self.v[self.p + 1] != "from" or self.v[self.p + 1] in ("{", "*")):
            self.p += 1
        if self.k[self.p] == NAME:
            self.binding()
            if self.ts and self.take("="):
                self.expression()
                self.semicolon()
                return
            if not self.take(","):
                self.from_()
                return
        if self.take("*"):
            self.need_word("as")
            self.binding()
        elif self.at("{"):
            self.specifiers()
        else:
            self.fail()
        self.from_()

    def from_(self) -> None:
        self.need_word("from")
        if self.k[self.p] != STRING:
            self.fail("expected a module name")
        self.p += 1
        self.attributes()
        self.semicolon()

    def attributes(self) -> None:
        if self.word("with") or (self.word("assert") and not self.nl[self.p]):
            self.p += 1
            self.object()

    def specifiers(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.ts and self.word("type") and self.k[self.p + 1] == NAME and self.v[self.p + 1] != "as":
                self.p += 1
            if self.k[self.p] not in (NAME, STRING):
                self.fail()
            self.p += 1
            if self.take_word("as"):
                if self.k[self.p] not in (NAME, STRING):
                    self.fail()
                self.p += 1
            if not self.at("}"):
                self.need(",")

    def export(self) -> None:
        if self.depth > 1 and not self.ambient:
            self.fail("export inside a block")
        self.module = True
        self.p += 1
        p = self.p
        v = self.v[p]
        if v == "default" and self.k[p] == NAME:
            self.p = p + 1
            if self.word("function"):
                self.p += 1
                self.function_rest(False, named=False)
            elif self.word("async") and self.v[self.p + 1] == "function" and not self.nl[self.p + 1]:
                self.p += 2
                self.function_rest(True, named=False)
            elif self.word("class") or self.at("@") or (self.ts and self.word("abstract") and self.v[self.p + 1] == "class"):
                while self.at("@"):
                    self.decorator()
                self.take_word("abstract")
                self.need_word("class")
                if self.k[self.p] == NAME and self.v[self.p] not in RESERVED and self.v[self.p] != "implements":
                    self.p += 1
                self.class_rest()
            elif self.ts and self.word("interface"):
                self.interface()
            else:
                self.assign()
                self.semicolon()
        elif v == "*":
            self.p = p + 1
            if self.take_word("as"):
                self.p += 1
            self.from_()
        elif v == "{":
            self.specifiers()
            if self.word("from"):
                self.from_()
            else:
                self.semicolon()
        elif self.ts and v == "=":
            self.p = p + 1
            self.expression()
            self.semicolon()
        elif self.ts and v == "as" and self.v[p + 1] == "namespace":
            self.p = p + 3
            self.semicolon()
        elif self.ts and v == "type" and self.v[p + 1] in ("{", "*"):
            self.p = p + 1
            if self.take("*"):
                if self.take_word("as"):
                    self.p += 1
            else:
                self.specifiers()
            if self.word("from"):
                self.from_()
            else:
                self.semicolon()
        elif v in ("var", "const", "function", "class", "@") or v in self.soft or (self.ts and v == "import"):
            before = self.p
            if v in self.soft:
                if self.soft[v]() is False:
                    self.fail()
            else:
                self.words[v]()
            if self.p == before:
                self.fail()
        else:
            self.fail()

    # TypeScript declarations

    def alias(self):
        p = self.p
        if self.k[p + 1] != NAME or self.nl[p + 1] or not (self.v[p + 2] in ("=", "<")):
            return False
        self.p = p + 2
        if self.at("<"):
            self.type_parameters()
        self.need("=")
        self.type()
        self.semicolon()
        return None

    def interface(self):
        p = self.p
        if self.k[p + 1] != NAME or self.nl[p + 1]:
            return False
        self.p = p + 2
        if self.at("<"):
            self.type_parameters()
        if self.take_word("extends"):
            self.type()
            while self.take(","):
                self.type()
        self.object_type()
        return None

    def enum(self):
        if self.k[self.p + 1] != NAME:
            return False
        self.p += 2
        self.need("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                self.assign()
            if not self.at("}"):
                self.need(",")
        return None

    def namespace(self):
        p = self.p
        if self.nl[p + 1] or self.k[p + 1] not in (NAME, STRING):
            return False
        self.p = p + 2
        while self.take("."):
            self.p += 1
        ambient, self.ambient = self.ambient, True
        try:
            if self.at("{"):
                self.block()
            else:
                self.semicolon()
        finally:
            self.ambient = ambient
        return None

    def global_(self):
        if self.v[self.p + 1] != "{" or not self.ambient:
            return False
        self.p += 1
        self.block()
        return None

    def declare(self):
        if self.nl[self.p + 1] or self.k[self.p + 1] != NAME or self.v[self.p + 1] in ("in", "instanceof", "as"):
            return False
        self.p += 1
        ambient, self.ambient = self.ambient, True
        try:
            self.statement()
        finally:
            self.ambient = ambient
        return None

    def abstract(self):
        if self.v[self.p + 1] != "class" or self.nl[self.p + 1]:
            return False
        self.p += 1
        self.class_statement()
        return None

    # types

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.k[self.p] == NAME and self.v[self.p] in ("const", "in", "out") and self.k[self.p + 1] == NAME:
                self.p += 1
            self.name()
            if self.take_word("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.at(">"):
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.take(","):
                break
        self.need(">")

    def return_type(self) -> None:
        if self.word("asserts") and self.k[self.p + 1] == NAME and not self.nl[self.p + 1]:
            self.p += 2
            if self.take_word("is"):
                self.type()
            return
        if self.k[self.p] == NAME and self.v[self.p + 1] == "is" and self.k[self.p + 1] == NAME and not self.nl[self.p + 1]:
            self.p += 2
        self.type()

    def type(self) -> None:
        self.union()
        if self.word("extends") and not self.nl[self.p] and not self.no_conditional:
            self.p += 1
            saved, self.no_conditional = self.no_conditional, True
            self.union()
            self.no_conditional = saved
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    no_conditional = False

    def union(self) -> None:
        self.take("|") or self.take("&")
        self.type_operand()
        while self.k[self.p] == PUNCT and self.v[self.p] in ("|", "&"):
            self.p += 1
            self.type_operand()

    def type_operand(self) -> None:
        while self.k[self.p] == NAME and self.v[self.p] in ("keyof", "unique", "readonly", "infer") and (self.k[self.p + 1] in (NAME, STRING) or self.v[self.p + 1] in ("(", "[", "{")):
            self.p += 1
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == NAME:
            if v in ("new", "abstract") and (self.v[p + 1] in ("(", "<", "new")):
                self.p += 1
                self.take_word("new")
                self.function_type()
                return
            if v == "typeof":
                self.p += 1
                if self.word("import"):
                    self.import_type()
                else:
                    self.name()
                    while self.take("."):
                        self.p += 1
            elif v == "import":
                self.import_type()
            elif v in RESERVED and v not in _KEYWORD_TYPES:
                self.fail("expected a type")
            else:
                self.p += 1
                while self.at(".") and self.k[self.p + 1] == NAME:
                    self.p += 2
            if self.at("<"):
                self.type_arguments()
        elif k in (STRING, NUMBER, TEMPLATE):
            self.p += 1
        elif k == HEAD:
            self.p += 1
            while True:
                self.type()
                if self.k[self.p] == MIDDLE:
                    self.p += 1
                    continue
                if self.k[self.p] != TAIL:
                    self.fail()
                self.p += 1
                break
        elif v == "-" and self.k[p + 1] == NUMBER:
            self.p += 2
        elif v == "(":
            close = self.match[p]
            if close > 0 and self.v[close + 1] == "=>" and self.k[close + 1] == PUNCT:
                self.function_type()
                return
            self.p += 1
            saved, self.no_conditional = self.no_conditional, False
            self.type()
            self.no_conditional = saved
            self.need(")")
        elif v == "<":
            self.function_type()
            return
        elif v == "{":
            if not self.attempt(self.mapped_type):
                self.object_type()
        elif v == "[":
            self.p += 1
            while not self.take("]"):
                self.take("...")
                if self.k[self.p] == NAME and (self.v[self.p + 1] == ":" or (self.v[self.p + 1] == "?" and self.v[self.p + 2] == ":")):
                    self.p += 1
                    self.take("?")
                    self.need(":")
                self.type()
                self.take("?")
                if not self.at("]"):
                    self.need(",")
        else:
            self.fail("expected a type")
        while self.at("[") and not self.nl[self.p]:
            self.p += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def import_type(self) -> None:
        self.p += 1
        self.need("(")
        self.type()
        self.need(")")
        while self.take("."):
            self.p += 1

    def function_type(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()

    def mapped_type(self) -> None:
        self.need("{")
        if self.at("+") or self.at("-"):
            self.p += 1
        self.take_word("readonly")
        self.need("[")
        self.name()
        self.need_word("in")
        self.type()
        if self.take_word("as"):
            self.type()
        self.need("]")
        if self.at("+") or self.at("-"):
            self.p += 1
        self.take("?")
        if self.take(":"):
            self.type()
        self.take(";")
        self.need("}")

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            while self.k[self.p] == NAME and self.v[self.p] in ("readonly", "get", "set") and (self.k[self.p + 1] in (NAME, STRING, NUMBER) or self.v[self.p + 1] == "["):
                self.p += 1
            if self.word("new") and self.v[self.p + 1] in ("(", "<"):
                self.p += 1
            if self.at("(") or self.at("<"):
                self.signature()
            elif self.at("[") and self.attempt(self.index_signature):
                pass
            else:
                self.property_name()
                self.take("?")
                if self.at("(") or self.at("<"):
                    self.signature()
                elif self.take(":"):
                    self.type()
            if not (self.take(";") or self.take(",")) and not self.at("}") and not self.nl[self.p]:
                self.fail()

    # expressions

    def name(self) -> None:
        if self.k[self.p] != NAME:
            self.fail("expected a name")
        self.p += 1

    def expression(self) -> int:
        kind = self.assign()
        while self.k[self.p] == PUNCT and self.v[self.p] == ",":
            self.p += 1
            self.assign()
            kind = VALUE
        if self.cover >= 0 and not self.no_in:
            at, self.cover = self.cover, -1
            raise SyntaxFailure("initialiser in an object literal", at)
        return kind

    def assign(self) -> int:
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == NAME:
            n = self.v[p + 1]
            if n == "=>" and self.k[p + 1] == PUNCT:
                if v in RESERVED:
                    self.fail()
                self.p = p + 2
                self.arrow_body(False)
                return VALUE
            if v == "async" and not self.nl[p + 1]:
                if self.k[p + 1] == NAME and self.v[p + 2] == "=>":
                    self.p = p + 3
                    self.arrow_body(True)
                    return VALUE
                if (n == "(" or (self.ts and n == "<")) and self.arrow_ahead(p + 1):
                    self.p = p + 1
                    if self.attempt(lambda: self.arrow(True)):
                        return VALUE
                    self.p = p
            elif v == "yield" and self.generator:
                self.p = p + 1
                if not self.nl[self.p]:
                    star = self.take("*")
                    if star or not (self.k[self.p] == END or (self.k[self.p] == PUNCT and self.v[self.p] in (")", "]", "}", ",", ";", ":"))):
                        self.assign()
                return VALUE
        elif k == PUNCT and (v == "(" or (self.ts and v == "<")) and self.arrow_ahead(p):
            if self.ts:
                if self.sure_arrow(p):
                    self.arrow(False)
                    return VALUE
                if self.attempt(lambda: self.arrow(False)):
                    return VALUE
            else:
                self.arrow(False)
                return VALUE
        kind = self.conditional()
        p = self.p
        if self.k[p] == PUNCT:
            v = self.v[p]
            if v == ">" and self.ts:
                n = p
                while self.v[n] == ">" and self.k[n] == PUNCT:
                    n += 1
                if self.v[n] == ">=":
                    self.p = n + 1
                    self.assign()
                    return VALUE
            if v in _ASSIGN:
                if kind == VALUE or (kind == PATTERN and v != "="):
                    self.fail("invalid assignment target")
                self.cover = -1
                self.p = p + 1
                self.assign()
                return VALUE
        return kind

    def arrow_ahead(self, p: int) -> bool:
        if self.v[p] == "<":
            return True
        close = self.match[p]
        if close < 0:
            return False
        after = self.v[close + 1]
        return self.k[close + 1] == PUNCT and (after == "=>" or (self.ts and after == ":"))

    def sure_arrow(self, p: int) -> bool:
        return self.v[p] == "(" and self.v[self.match[p] + 1] == "=>"

    def arrow(self, is_async: bool) -> None:
        self.signature()
        if self.nl[self.p]:
            self.fail()
        self.need("=>")
        self.arrow_body(is_async)

    def arrow_body(self, is_async: bool) -> None:
        if self.at("{"):
            self.body(is_async, False)
        else:
            saved = self.is_async, self.generator
            self.is_async, self.generator = is_async or (self.is_async and not self.function), False
            try:
                self.assign()
            finally:
                self.is_async, self.generator = saved

    def conditional(self) -> int:
        kind = self.binary(0)
        if self.k[self.p] == PUNCT and self.v[self.p] == "?":
            self.p += 1
            self.assign_in()
            self.need(":")
            self.assign()
            return VALUE
        return kind

    def binary(self, least: int) -> int:
        kind = self.unary()
        k, v = self.k, self.v
        while True:
            p = self.p
            x = v[p]
            if k[p] == PUNCT:
                level = _BINARY.get(x)
                if level is None:
                    return kind
                step = 1
                if x == ">" and self.ts:
                    starts = self.tokens.starts
                    while v[p + step] == ">" and k[p + step] == PUNCT and starts[p + step] == starts[p] + step:
                        step += 1
                    if v[p + step] == ">=" and starts[p + step] == starts[p] + step:
                        return kind
                    if step > 1:
                        level = 9
                if level <= least:
                    return kind
                self.p = p + step
                self.binary(level - 1 if x == "**" else level)
                kind = VALUE
            elif k[p] == NAME and (x == "instanceof" or (x == "in" and not self.no_in)):
                if least >= 8:
                    return kind
                self.p = p + 1
                self.binary(8)
                kind = VALUE
            elif self.ts and k[p] == NAME and x in ("as", "satisfies") and not self.nl[p]:
                if least >= 8:
                    return kind
                self.p = p + 1
                if not self.take_word("const"):
                    self.type()
            else:
                return kind

    def unary(self) -> int:
        p = self.p
        k, v = self.k[p], self.v[p]
        if k == PUNCT:
            if v in _PREFIX:
                self.p = p + 1
                self.unary()
                if self.at("**"):
                    self.fail("unary operator before **")
                return VALUE
            if v == "++" or v == "--":
                self.p = p + 1
                if self.unary() != TARGET:
                    self.fail("invalid target")
                return VALUE
            if v == "<" and self.ts:
                self.p = p + 1
                if not self.take_word("const"):
                    self.type()
                self.need(">")
                self.unary()
                return VALUE
        elif k == NAME:
            if v in _PREFIX_WORDS:
                self.p = p + 1
                self.unary()
                return VALUE
            if v == "await" and (self.is_async or not self.function):
                n = self.p + 1
                if self.is_async and self.function or not (self.k[n] == PUNCT and self.v[n] not in ("(", "[", "{", "!", "+", "-") or self.k[n] == END):
                    self.p = n
                    self.unary()
                    return VALUE
        kind = self.postfix()
        p = self.p
        if self.k[p] == PUNCT and (self.v[p] == "++" or self.v[p] == "--") and not self.nl[p]:
            if kind != TARGET:
                self.fail("invalid target")
            self.p = p + 1
            return VALUE
        return kind

    def postfix(self) -> int:
        kind = self.primary()
        optional = False
        k, v = self.k, self.v
        while True:
            p = self.p
            if k[p] == PUNCT:
                x = v[p]
                if x == ".":
                    if k[p + 1] not in (NAME, PRIVATE):
                        self.p = p + 1
                        self.fail()
                    self.p = p + 2
                    kind = VALUE if optional else TARGET
                elif x == "(":
                    self.arguments()
                    kind = VALUE
                elif x == "[":
                    self.p = p + 1
                    no_in, self.no_in = self.no_in, False
                    self.expression()
                    self.no_in = no_in
                    self.need("]")
                    kind = VALUE if optional else TARGET
                elif x == "?.":
                    optional = True
                    kind = VALUE
                    self.p = p + 1
                    if k[p + 1] in (NAME, PRIVATE):
                        self.p = p + 2
                    elif v[p + 1] not in ("(", "["):
                        self.fail()
                elif self.ts and x == "!" and not self.nl[p]:
                    self.p = p + 1
                elif self.ts and x == "<":
                    if not self.attempt(self.call_types):
                        return kind
                else:
                    return kind
            elif k[p] == TEMPLATE or k[p] == HEAD:
                self.template()
                kind = VALUE
            else:
                return kind

    def call_types(self) -> None:
        self.type_arguments()
        p = self.p
        if self.k[p] in (TEMPLATE, HEAD):
            return
        if self.k[p] != PUNCT and self.k[p] != END and not self.nl[p] or self.v[p] not in ("(", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "}", ""):
            self.fail()

    def arguments(self) -> None:
        self.p += 1
        no_in, self.no_in = self.no_in, False
        k, v = self.k, self.v
        while True:
            if k[self.p] == PUNCT:
                if v[self.p] == ")":
                    self.p += 1
                    break
                if v[self.p] == "...":
                    self.p += 1
            self.assign()
            if k[self.p] == PUNCT and v[self.p] == ",":
                self.p += 1
                continue
            self.need(")")
            break
        self.no_in = no_in

    def template(self) -> None:
        p = self.p
        if self.k[p] == TEMPLATE:
            self.p = p + 1
            return
        self.p = p + 1
        while True:
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
                if v == "async" and self.v[p + 1] == "function" and not self.nl[p + 1]:
                    self.p = p + 2
                    self.function_rest(True, named=False)
                    return VALUE
                if v == "await" and self.module and self.function:
                    self.fail("await outside an async function")
                self.p = p + 1
                return TARGET
            if v in ("this", "null", "true", "false"):
                self.p = p + 1
                return VALUE
            if v == "function":
                self.p = p + 1
                self.function_rest(False, named=False)
                return VALUE
            if v == "new":
                return self.new()
            if v == "class":
                self.p = p + 1
                if self.k[self.p] == NAME and self.v[self.p] not in RESERVED and self.v[self.p] != "implements":
                    self.p += 1
                self.class_rest()
                return VALUE
            if v == "super":
                if self.v[p + 1] not in ("(", ".", "["):
                    self.fail()
                self.p = p + 1
                return VALUE
            if v == "import":
                if self.v[p + 1] == ".":
                    self.module = True
                    self.p = p + 3
                    return VALUE
                if self.v[p + 1] == "(":
                    self.p = p + 1
                    return VALUE
            self.fail()
        if k == STRING or k == NUMBER or k == REGEX or k == ELEMENT:
            self.p = p + 1
            return VALUE
        if k == TEMPLATE or k == HEAD:
            self.template()
            return VALUE
        if k == PUNCT:
            if v == "(":
                return self.group()
            if v == "[":
                self.p = p + 1
                no_in, self.no_in = self.no_in, False
                while not self.take("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assign()
                    if not self.at("]"):
                        self.need(",")
                self.no_in = no_in
                return PATTERN
            if v == "{":
                self.object()
                return PATTERN
            if v == "@":
                while self.at("@"):
                    self.decorator()
                self.need_word("class")
                if self.k[self.p] == NAME and self.v[self.p] not in RESERVED:
                    self.p += 1
                self.class_rest()
                return VALUE
        elif k == PRIVATE and self.v[p + 1] == "in":
            self.p = p + 1
            return VALUE
        self.fail()
        return VALUE

    def group(self) -> int:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        kind = self.expression()
        self.no_in = no_in
        self.need(")")
        return TARGET if kind == TARGET else VALUE

    def new(self) -> int:
        self.p += 1
        if self.take("."):
            self.need_word("target")
            return VALUE
        if self.word("new"):
            self.new()
        else:
            self.primary()
        while True:
            if self.at("."):
                self.p += 1
                if self.k[self.p] not in (NAME, PRIVATE):
                    self.fail()
                self.p += 1
            elif self.at("["):
                self.p += 1
                self.expression()
                self.need("]")
            else:
                break
        if self.ts and self.at("<"):
            self.attempt(self.type_arguments)
        if self.at("("):
            self.arguments()
        return VALUE

    def object(self) -> None:
        self.need("{")
        no_in, self.no_in = self.no_in, False
        k, v = self.k, self.v
        while not self.take("}"):
            if self.take("..."):
                self.assign()
            else:
                p = self.p
                is_async = star = accessor = False
                if k[p] == NAME:
                    n = v[p + 1]
                    if v[p] in ("async", "get", "set") and (k[p + 1] in (NAME, STRING, NUMBER) or n == "[" or (n == "*" and v[p] == "async")):
                        is_async = v[p] == "async"
                        accessor = not is_async
                        self.p = p + 1
                if self.take("*"):
                    star = True
                name = k[self.p] == NAME and v[self.p] not in RESERVED
                self.property_name()
                if k[self.p] == PUNCT and v[self.p] == ":" and not (is_async or star or accessor):
                    self.p += 1
                    self.assign()
                elif self.at("(") or (self.ts and self.at("<")):
                    self.signature()
                    self.body(is_async, star)
                elif not name or is_async or star or accessor:
                    self.fail()
                elif self.at("="):
                    self.cover = self.tokens.starts[self.p]
                    self.p += 1
                    self.assign()
            if not self.at("}"):
                self.need(",")
        self.no_in = no_in


def parse(text: str, ts: bool = False, elements: bool = False) -> list[tuple[str, int]]:
    """All syntax errors of a script as (message, offset), the first cause first."""
    tokens = lex(text, ts, elements)
    errors = Ecma(tokens, ts).program()
    waiting = list(tokens.inner)
    while waiting:
        inner = waiting.pop()
        waiting += inner.inner
        errors += Ecma(inner, ts).contained()
    return sorted(errors, key=lambda e: e[1])
