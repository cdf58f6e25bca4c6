"""Python 3.13."""

from __future__ import annotations

import re

from graphloom.llm.parsing.base import Panic, Parser, SyntaxIssue, Tokens

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\n)
    |(?P<com>\#[^\n]*)
    |(?P<nl>\n)
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))
    |(?P<str>(?:[rR]?[fF]|[fF][rR]|[rR]?[bB]|[bB][rR]|[uU]|[rR])?(?:\"\"\"|'''|"|'))
    |(?P<id>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|>>|<<|<=|>=|==|!=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:.;=!])""",
    re.X,
)
# The language's keywords.
_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|or|not)\b")
_BODY = {
    '"': re.compile(r'(?:[^"\\\n]|\\[\s\S])*"'), "'": re.compile(r"(?:[^'\\\n]|\\[\s\S])*'"),
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'), "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
}
_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N(?!\{[^}]+\}))")
_BAD_BYTE = re.compile(r"\\x(?![0-9a-fA-F]{2})")
_ESCAPED = re.compile(r"\\[^xuUN]")
_LEVEL = {
    "or": 1, "and": 2, **dict.fromkeys(["in", "not", "is", "<", ">", "<=", ">=", "==", "!="], 4),
    "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10,
}
_AUGMENTED = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])


def _escapes_ok(body: str, bytes_: bool) -> bool:
    if "\\" not in body:
        return True
    body = _ESCAPED.sub("", body)
    return not (_BAD_BYTE if bytes_ else _ESCAPE).search(body)


class Lexer:
    """Tokens with nl, indent and dedent; f-strings as fs_start, fs_open, ..., fs_close, fs_end."""

    def __init__(self, source: str) -> None:
        self.s, self.out = source, Tokens()
        self.levels = [(0, 0)]

    def run(self) -> Tokens:
        s, out, at, depth = self.s, self.out, 0, 0
        n, fresh = len(s), True
        while at < n:
            if fresh and not depth:
                at = self.indentation(at)
                fresh = False
                continue
            m = _TOKEN.match(s, at)
            if m is None:
                out.add("bad", s[at], at)
                at += 1
                continue
            kind = m.lastgroup
            if kind == "nl":
                at = m.end()
                if not depth:
                    out.add("nl", "\n", m.start())
                    fresh = True
                continue
            if kind == "ws" and m.end() >= n and s[m.start()] == "\\":
                out.add("bad", "\\", at)
            at = self.token(m, kind)
            if out.kind and kind == "op":
                if out.kind[-1] in ("(", "[", "{"):
                    depth += 1
                elif out.kind[-1] in (")", "]", "}"):
                    depth = max(0, depth - 1)
        if out.kind and out.kind[-1] != "nl" and not depth:
            out.add("nl", "\n", n)
        if not depth:
            for _ in self.levels[1:]:
                out.add("dedent", "", n)
        out.add("eof", "", n)
        return out

    def token(self, m: re.Match[str], kind: str) -> int:
        """Adds one token and returns where it ends."""
        out, at, end, text = self.out, m.start(), m.end(), m.group()
        if kind in ("ws", "com"):
            return end
        if kind == "str":
            return self.string(at, end, text)
        if kind == "num":
            rest = self.s[end : end + 4]
            digits = text.replace("_", "")
            wrong = digits.isdigit() and digits[0] == "0" and digits.strip("0")
            if wrong or (rest[:1] and (rest[0].isalnum() or rest[0] == "_") and not _AFTER_NUMBER.match(self.s, end)):
                kind = "bad"
        elif kind == "op" or text in _KEYWORDS:
            kind = text
        out.add(kind, text, at)
        return end

    def indentation(self, at: int) -> int:
        s, n = self.s, len(self.s)
        column = other = 0
        while at < n:
            c = s[at]
            if c == " ":
                column, other = column + 1, other + 1
            elif c == "\t":
                column, other = (column // 8 + 1) * 8, other + 1
            elif c == "\f":
                column = other = 0
            else:
                break
            at += 1
        if at >= n or s[at] in "#\n":
            end = s.find("\n", at)
            if end < 0:
                return n
            nxt = end + 1
            return self.indentation_after(nxt)
        if s.startswith("\\\n", at):
            return at
        top = self.levels[-1]
        if column == top[0]:
            if other != top[1]:
                self.out.add("bad", "tabs and spaces mixed", at)
        elif column > top[0]:
            if other <= top[1]:
                self.out.add("bad", "tabs and spaces mixed", at)
            self.levels.append((column, other))
            self.out.add("indent", "", at)
        else:
            while column < self.levels[-1][0]:
                self.levels.pop()
                self.out.add("dedent", "", at)
            if (column, other) != self.levels[-1]:
                self.out.add("bad", "indentation matches no outer level", at)
        return at

    def indentation_after(self, at: int) -> int:
        """Goes on after a blank line without recursion growing with the number of such lines."""
        m = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*").match(self.s, at)
        return self.indentation(m.end())

    def string(self, at: int, end: int, opening: str) -> int:
        quote = opening.lstrip("rRfFbBuU")
        prefix = opening[: len(opening) - len(quote)].lower()
        if "f" in prefix:
            return self.fstring(at, end, quote, "r" in prefix)
        m = _BODY[quote].match(self.s, end)
        if m is None:
            self.out.add("bad", "string not closed", at)
            stop = self.s.find("\n", end) if len(quote) == 1 else -1
            return len(self.s) if stop < 0 else stop
        body = m.group()
        kind = "bytes" if "b" in prefix else "str"
        if ("r" not in prefix and not _escapes_ok(body, kind == "bytes")) or (kind == "bytes" and not body.isascii()):
            kind = "bad"
        self.out.add(kind, "", at)
        return m.end()

    def fstring(self, start: int, at: int, quote: str, raw: bool) -> int:
        s, out, n = self.s, self.out, len(self.s)
        out.add("fs_start", "", start)
        while at < n:
            c = s[at]
            if s.startswith(quote, at):
                out.add("fs_end", "", at)
                return at + len(quote)
            if c == "\\":
                if not raw and not _escapes_ok(s[at : at + 12], False) and s[at + 1 : at + 2] in "xuUN":
                    out.add("bad", "\\", at)
                if not raw and s.startswith("\\N{", at):
                    at = s.find("}", at) + 1 or n
                else:
                    at += 1 if s[at + 1 : at + 2] in "{}" else 2
            elif s.startswith(("{{", "}}"), at):
                at += 2
            elif c == "{":
                at = self.field(at, quote)
            elif c == "}" or (c == "\n" and len(quote) == 1):
                out.add("bad", c, at)
                return at + 1
            else:
                at += 1
        out.add("bad", "string not closed", start)
        return n

    def field(self, at: int, quote: str) -> int:
        s, out, n = self.s, self.out, len(self.s)
        out.add("fs_open", "{", at)
        at, depth = at + 1, 0
        while at < n:
            c = s[at]
            if not depth:
                if c == "}":
                    out.add("fs_close", "}", at)
                    return at + 1
                if c == "!" and not s.startswith("!=", at):
                    m = re.compile(r"![ ]*([^\W\d]\w*)?\s*").match(s, at)
                    out.add("fs_conv" if m.group(1) in ("r", "s", "a") else "bad", m.group(), at)
                    at = m.end()
                    continue
                if c == ":":
                    return self.spec(at + 1, quote)
                if c == "=" and not s.startswith("==", at) and re.compile(r"=\s*[!:}]").match(s, at):
                    out.add("fs_debug", "=", at)
                    at += 1
                    continue
            if c == "\n":
                at += 1
                continue
            m = _TOKEN.match(s, at)
            if m is None:
                out.add("bad", c, at)
                return at + 1
            at = self.token(m, m.lastgroup)
            if m.lastgroup == "op":
                depth += (m.group() in "([{") - (m.group() in ")]}") if len(m.group()) == 1 else 0
        return at

    def spec(self, at: int, quote: str) -> int:
        s, out, n = self.s, self.out, len(self.s)
        out.add("fs_spec", ":", at)
        while at < n:
            if s[at] == "{":
                at = self.field(at, quote)
            elif s[at] == "}":
                out.add("fs_close", "}", at)
                return at + 1
            elif s.startswith(quote, at) or (s[at] == "\n" and len(quote) == 1):
                out.add("bad", "expected }", at)
                return at
            else:
                at += 1
        return at


# What an expression is, as far as assignment asks: (sort, parts).
NAME, PLACE, OTHER = ("name", ()), ("place", ()), ("other", ())


def assignable(node: tuple, star: bool = True) -> bool:
    sort, parts = node
    if sort in ("name", "place"):
        return True
    if sort in ("tuple", "list"):
        return all(assignable(x, star) for x in parts)
    if sort == "star":
        return star and assignable(parts[0])
    return sort == "paren" and assignable(parts[0], False)


class Python(Parser):
    RESUME = frozenset(["def", "class", "import", "if", "for", "while", "return", "with", "try"])

    def __init__(self, source: str) -> None:
        super().__init__(source, Lexer(source).run())

    def attempt(self, item) -> bool:
        start = self.i
        try:
            if item() is not False:
                return True
        except Panic:
            pass
        self.i = start
        return False

    def document(self) -> None:
        while not self.at("eof"):
            if not self.accept("nl"):
                self.guarded(self.statement)

    def word(self, word: str) -> bool:
        return self.k[self.i] == "id" and self.t[self.i] == word

    # -- statements

    def statement(self) -> None:
        kind = self.k[self.i]
        compound = self.COMPOUND.get(kind)
        if compound is not None:
            compound(self)
        elif kind == "id" and self.t[self.i] == "match" and self.attempt(self.match_head):
            self.cases()
        else:
            self.simple_line()

    def simple_line(self) -> None:
        self.simple()
        while self.accept(";"):
            if self.at("nl"):
                break
            self.simple()
        self.expect("nl")

    def block(self) -> None:
        self.expect(":")
        if not self.accept("nl"):
            if self.k[self.i] in self.COMPOUND:
                self.fail("simple statement expected")
            return self.simple_line()
        self.expect("indent")
        while not self.accept("dedent"):
            if self.at("eof"):
                self.fail("block not closed")
            if self.at("indent"):
                self.fail("unexpected indent")
            self.statement()

    def if_(self) -> None:
        self.skip()
        self.named()
        self.block()
        while self.accept("elif"):
            self.named()
            self.block()
        if self.accept("else"):
            self.block()

    def while_(self) -> None:
        self.skip()
        self.named()
        self.block()
        if self.accept("else"):
            self.block()

    def for_(self) -> None:
        self.expect("for")
        self.targets()
        self.expect("in")
        self.star_expressions()
        self.block()
        if self.accept("else"):
            self.block()

    def targets(self) -> None:
        """Targets of a loop, up to ``in``."""
        node = self.target()
        while self.accept(","):
            if self.at("in"):
                break
            other = self.target()
            node = ("tuple", (node, other))
        if not assignable(node):
            self.fail("not assignable")

    def target(self) -> tuple:
        if self.accept("*"):
            return ("star", (self.binary(5),))
        return self.binary(5)

    def try_(self) -> None:
        self.skip()
        self.block()
        found = False
        while self.accept("except"):
            found = True
            star = self.accept("*")
            if not self.at(":"):
                self.expression()
                if self.accept("as"):
                    self.expect("id")
            elif star:
                self.fail("expression expected")
            self.block()
        if found and self.accept("else"):
            self.block()
        if self.accept("finally"):
            self.block()
        elif not found:
            self.fail("expected except or finally")

    def with_(self) -> None:
        self.expect("with")
        if not (self.at("(") and self.attempt(self.with_group)):
            self.with_item()
            while self.accept(","):
                self.with_item()
        self.block()

    def with_group(self) -> bool:
        self.expect("(")
        self.with_item()
        while self.accept(","):
            if self.at(")"):
                break
            self.with_item()
        self.expect(")")
        return self.at(":")

    def with_item(self) -> None:
        self.expression()
        if self.accept("as"):
            if not assignable(self.target()):
                self.fail("not assignable")

    def async_(self) -> None:
        self.skip()
        if not self.at("def", "for", "with"):
            self.fail("expected def, for or with")
        self.COMPOUND[self.k[self.i]](self)

    def decorated(self) -> None:
        while self.accept("@"):
            self.named()
            self.expect("nl")
        if not self.at("def", "class", "async"):
            self.fail("expected def or class")
        if self.at("async") and self.ahead() != "def":
            self.fail("expected def")
        self.statement()

    def def_(self) -> None:
        self.expect("def")
        self.expect("id")
        self.type_parameters()
        self.expect("(")
        self.parameters(")", True)
        if self.accept("->"):
            self.expression()
        self.block()

    def class_(self) -> None:
        self.skip()
        self.expect("id")
        self.type_parameters()
        if self.accept("("):
            self.arguments()
        self.block()

    def type_parameters(self) -> None:
        if not self.accept("["):
            return
        if self.at("]"):
            self.fail("type parameter expected")
        while not self.accept("]"):
            star = self.accept("*") or self.accept("**")
            self.expect("id")
            if self.accept(":"):
                if star:
                    self.fail("bound not allowed")
                self.expression()
            if self.accept("="):
                self.star_or_expression()
            if not self.at("]"):
                self.expect(",")

    def parameters(self, close: str, annotated: bool) -> None:
        defaults = star = slash = named = False
        while not self.accept(close):
            if self.accept("/"):
                if slash or star or not named:
                    self.fail("misplaced /")
                slash = True
            elif self.accept("**"):
                self.parameter_name(annotated)
                self.accept(",")
                return self.expect(close)
            elif self.accept("*"):
                if star:
                    self.fail("misplaced *")
                star = True
                if self.at(","):
                    if self.ahead() != "id":
                        self.fail("parameter expected after *")
                else:
                    self.expect("id")
                    if annotated and self.accept(":"):
                        self.star_or_expression()
            else:
                self.parameter_name(annotated)
                named = True
                if self.accept("="):
                    self.expression()
                    defaults = True
                elif defaults and not star:
                    self.fail("parameter without a default follows one with a default")
            if not self.accept(",") and not self.at(close):
                self.fail(f"expected {close}")

    def parameter_name(self, annotated: bool) -> None:
        self.expect("id")
        if annotated and self.accept(":"):
            self.expression()

    # -- match

    def match_head(self) -> bool:
        self.skip()
        self.star_expressions(named=True)
        self.expect(":")
        self.expect("nl")
        self.expect("indent")
        return self.word("case")

    def cases(self) -> None:
        while not self.accept("dedent"):
            if not self.word("case"):
                self.fail("expected case")
            self.skip()
            self.pattern_sequence()
            if self.accept("if"):
                self.named()
            self.block()

    def pattern_sequence(self) -> None:
        self.star_pattern()
        while self.accept(","):
            if self.at("if", ":"):
                return
            self.star_pattern()

    def star_pattern(self) -> None:
        if self.accept("*"):
            self.expect("id")
        else:
            self.pattern()

    def pattern(self) -> None:
        self.closed_pattern()
        while self.accept("|"):
            self.closed_pattern()
        if self.accept("as"):
            self.expect("id")

    def closed_pattern(self) -> None:
        kind = self.k[self.i]
        if kind in ("-", "num"):
            self.accept("-")
            self.expect("num")
            if self.accept("+") or self.accept("-"):
                self.expect("num")
        elif kind in ("str", "bytes", "fs_start"):
            self.strings()
        elif kind in ("None", "True", "False"):
            self.skip()
        elif kind == "id":
            self.skip()
            while self.accept("."):
                self.expect("id")
            if self.accept("("):
                self.group(")", self.class_pattern)
        elif kind == "(":
            self.skip()
            self.group(")", self.star_pattern)
        elif kind == "[":
            self.skip()
            self.group("]", self.star_pattern)
        elif kind == "{":
            self.skip()
            self.group("}", self.mapping_pattern)
        else:
            self.fail("pattern expected")

    def class_pattern(self) -> None:
        if self.at("id") and self.ahead() == "=":
            self.i += 2
        self.pattern()

    def mapping_pattern(self) -> None:
        if self.accept("**"):
            return self.expect("id")
        self.closed_pattern()
        self.expect(":")
        self.pattern()

    # -- simple statements

    def simple(self) -> None:
        kind = self.k[self.i]
        if kind in ("pass", "break", "continue"):
            self.skip()
        elif kind == "return":
            self.skip()
            if not self.at("nl", ";"):
                self.star_expressions()
        elif kind == "raise":
            self.skip()
            if not self.at("nl", ";"):
                self.expression()
                if self.accept("from"):
                    self.expression()
        elif kind in ("global", "nonlocal"):
            self.skip()
            self.expect("id")
            while self.accept(","):
                self.expect("id")
        elif kind == "del":
            self.skip()
            while True:
                if not assignable(self.binary(5), False):
                    self.fail("can't be deleted")
                if not self.accept(",") or self.at("nl", ";"):
                    break
        elif kind == "assert":
            self.skip()
            self.expression()
            if self.accept(","):
                self.expression()
        elif kind == "import":
            self.skip()
            self.module()
            while self.accept(","):
                self.module()
        elif kind == "from":
            self.from_()
        elif kind == "id" and self.t[self.i] == "type" and self.ahead() == "id" and self.attempt(self.type_alias):
            pass
        else:
            self.assignment()

    def type_alias(self) -> None:
        self.i += 2
        self.type_parameters()
        self.expect("=")
        self.expression()

    def dotted(self) -> None:
        self.expect("id")
        while self.accept("."):
            self.expect("id")

    def module(self) -> None:
        self.dotted()
        if self.accept("as"):
            self.expect("id")

    def imported(self) -> None:
        self.expect("id")
        if self.accept("as"):
            self.expect("id")

    def from_(self) -> None:
        self.skip()
        dots = False
        while self.accept(".") or self.accept("..."):
            dots = True
        if not dots or not self.at("import"):
            self.dotted()
        self.expect("import")
        if self.accept("*"):
            return
        if self.accept("("):
            if self.at(")"):
                self.fail("name expected")
            return self.group(")", self.imported)
        self.imported()
        while self.accept(","):
            self.imported()

    def value(self) -> tuple:
        return self.yield_() if self.at("yield") else self.star_expressions()

    def assignment(self) -> None:
        node = self.value()
        kind = self.k[self.i]
        if kind == ":":
            inner = node[1][0] if node[0] == "paren" else node
            if inner[0] not in ("name", "place"):
                self.fail("can't be annotated")
            self.skip()
            self.expression()
            if self.accept("="):
                self.value()
        elif kind == "=":
            while self.accept("="):
                if not assignable(node):
                    self.fail("not assignable")
                node = self.value()
        elif kind in _AUGMENTED:
            if node[0] not in ("name", "place") and not (node[0] == "paren" and node[1][0][0] in ("name", "place")):
                self.fail("not assignable")
            self.skip()
            self.value()

    # -- expressions

    def star_expressions(self, named: bool = False) -> tuple:
        node = self.star_expression(named)
        if not self.at(","):
            return node
        parts = [node]
        while self.accept(","):
            if not self.starts_expression():
                break
            parts.append(self.star_expression(named))
        return ("tuple", tuple(parts))

    def star_expression(self, named: bool = False) -> tuple:
        if self.accept("*"):
            return ("star", (self.binary(5),))
        return self.named() if named else self.expression()

    def star_or_expression(self) -> None:
        self.star_expression()

    def starts_expression(self) -> bool:
        return self.at("id", "num", "str", "bytes", "fs_start", "(", "[", "{", "-", "+", "~", "not", "lambda", "await", "None", "True", "False", "...", "*", "yield", "bad")

    def yield_(self) -> tuple:
        self.skip()
        if self.accept("from"):
            self.expression()
        elif self.starts_expression():
            self.star_expressions()
        return OTHER

    def named(self) -> tuple:
        if self.at("id") and self.ahead() == ":=":
            self.i += 2
            self.expression()
            return OTHER
        return self.expression()

    def expression(self) -> tuple:
        if self.at("lambda"):
            self.skip()
            self.parameters(":", False)
            self.expression()
            return OTHER
        node = self.binary(1)
        if self.accept("if"):
            self.binary(1)
            self.expect("else")
            self.expression()
            return OTHER
        return node

    def binary(self, least: int) -> tuple:
        if self.at("not"):
            if least > 3:
                self.fail("expression expected")
            self.skip()
            self.binary(3)
            node = OTHER
        else:
            node = self.unary()
        while True:
            kind = self.k[self.i]
            level = _LEVEL.get(kind)
            if level is None or level < least:
                return node
            self.i += 1
            if kind == "not":
                self.expect("in")
            elif kind == "is":
                self.accept("not")
            self.binary(level + 1)
            node = OTHER

    def unary(self) -> tuple:
        if self.at("-", "+", "~"):
            self.skip()
            self.unary()
            return OTHER
        awaited = self.accept("await")
        node = self.primary()
        if self.accept("**"):
            self.unary()
            return OTHER
        return OTHER if awaited else node

    def primary(self) -> tuple:
        node = self.atom()
        while True:
            kind = self.k[self.i]
            if kind == ".":
                self.i += 1
                self.expect("id")
                node = PLACE
            elif kind == "(":
                self.i += 1
                self.arguments()
                node = OTHER
            elif kind == "[":
                self.i += 1
                self.slices()
                node = PLACE
            else:
                return node

    def arguments(self) -> None:
        keyword = double = False
        n = 0
        while not self.accept(")"):
            n += 1
            if self.accept("**"):
                self.expression()
                double = keyword = True
            elif self.accept("*"):
                if double:
                    self.fail("* after **")
                self.expression()
            elif self.at("id") and self.ahead() == "=":
                self.i += 2
                self.expression()
                keyword = True
            else:
                if keyword:
                    self.fail("positional argument follows keyword argument")
                self.named()
                if self.at("for", "async"):
                    self.comprehension()
                    if n > 1 or not self.at(")"):
                        self.fail("generator needs parentheses")
            if not self.accept(",") and not self.at(")"):
                self.fail("expected )")

    def slices(self) -> None:
        if self.at("]"):
            self.fail("index expected")
        while not self.accept("]"):
            if self.accept("*"):
                self.binary(5)
            else:
                if not self.at(":"):
                    self.named()
                if self.accept(":"):
                    if not self.at(":", "]", ","):
                        self.expression()
                    if self.accept(":") and not self.at("]", ","):
                        self.expression()
            if not self.accept(",") and not self.at("]"):
                self.fail("expected ]")

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.accept("async")
            self.expect("for")
            self.targets()
            self.expect("in")
            self.binary(1)
            while self.accept("if"):
                self.binary(1)

    def strings(self) -> None:
        first = self.k[self.i] == "bytes"
        while self.at("str", "bytes", "fs_start"):
            if (self.k[self.i] == "bytes") != first:
                self.fail("bytes and text mixed")
            if self.skip() == "fs_start":
                while self.at("fs_open"):
                    self.replacement()
                self.expect("fs_end")

    def replacement(self) -> None:
        self.expect("fs_open")
        self.value()
        self.accept("fs_debug")
        self.accept("fs_conv")
        if self.accept("fs_spec"):
            while self.at("fs_open"):
                self.replacement()
        self.expect("fs_close")

    def atom(self) -> tuple:
        kind = self.k[self.i]
        if kind == "id":
            self.i += 1
            return NAME
        if kind in ("num", "None", "True", "False", "..."):
            self.i += 1
            return OTHER
        if kind in ("str", "bytes", "fs_start"):
            self.strings()
            return OTHER
        if kind == "(":
            self.i += 1
            return self.parenthesised()
        if kind == "[":
            self.i += 1
            return ("list", self.elements("]"))
        if kind == "{":
            self.i += 1
            self.braces()
            return OTHER
        self.fail("expression expected")

    def parenthesised(self) -> tuple:
        if self.accept(")"):
            return ("tuple", ())
        if self.at("yield"):
            self.yield_()
            self.expect(")")
            return OTHER
        node = self.star_expression(named=True)
        if self.at("for", "async"):
            if node[0] == "star":
                self.fail("* in a comprehension")
            self.comprehension()
            self.expect(")")
            return OTHER
        if self.accept(")"):
            if node[0] == "star":
                self.fail("* needs a tuple")
            return ("paren", (node,))
        parts = [node]
        while not self.accept(")"):
            self.expect(",")
            if self.accept(")"):
                break
            parts.append(self.star_expression(named=True))
        return ("tuple", tuple(parts))

    def elements(self, close: str) -> tuple:
        parts: list[tuple] = []
        while not self.accept(close):
            parts.append(self.star_expression(named=True))
            if len(parts) == 1 and self.at("for", "async"):
                if parts[0][0] == "star":
                    self.fail("* in a comprehension")
                self.comprehension()
                self.expect(close)
                return (OTHER,)
            if not self.accept(",") and not self.at(close):
                self.fail(f"expected {close}")
        return tuple(parts)

    def braces(self) -> None:
        if self.accept("}"):
            return
        mapping = self.entry(None)
        if self.at("for", "async"):
            if self.k[self.i - 1] != "}" and mapping == "unpacked":
                self.fail("unpacking in a comprehension")
            self.comprehension()
            return self.expect("}")
        mapping = mapping == "pair" or mapping == "double"
        while not self.accept("}"):
            self.expect(",")
            if self.accept("}"):
                return
            self.entry(mapping)

    def entry(self, mapping: bool | None) -> str:
        if self.at("**") and mapping is not False:
            self.skip()
            self.binary(5)
            if self.at("for", "async"):
                self.fail("unpacking in a comprehension")
            return "double"
        if self.at("*") and not mapping:
            self.skip()
            self.binary(5)
            return "unpacked"
        self.named()
        if mapping or (mapping is None and self.at(":")):
            self.expect(":")
            self.expression()
            return "pair"
        return "single"

    COMPOUND = {"if": if_, "while": while_, "for": for_, "try": try_, "with": with_, "async": async_, "def": def_, "class": class_, "@": decorated}


def check(source: str) -> list[SyntaxIssue]:
    if "\0" in source:
        return [SyntaxIssue(source.count("\n", 0, source.index("\0")) + 1, "null character")]
    p = Python(source.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿"))
    p.document()
    return p.issues
