"""Rust."""

from __future__ import annotations

import re

from graphloom.llm.parsing.base import Parser, SyntaxIssue, Tokens, scan

_TOKEN = re.compile(
    r"""(?P<ws>\s+)
    |(?P<doc>(?://[/!]|/\*[*!]))
    |(?P<com>//[^\n]*)
    |(?P<block>/\*)
    |(?P<raw>(?:b|c)?r\#*")
    |(?P<str>(?:b|c)?"(?:[^"\\]|\\(?s:.))*")
    |(?P<char>b?'(?:[^'\\\n\t]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')
    |(?P<life>'[^\W\d]\w*)
    |(?P<num>(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?[\d_]+)?|[eE][+-]?[\d_]+|\.(?![.\w]))?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w))
    |(?P<id>(?:r\#)?[^\W\d]\w*)
    |(?P<op><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[-+*/%^!&|=<>@.,;:\#$?~()\[\]{}])""",
    re.X,
)
# The language's keywords.
_KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
_LEVEL = {
    **dict.fromkeys(["=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="], 1), "..": 2, "..=": 2, "||": 3, "&&": 4,
    **dict.fromkeys(["==", "!=", "<", ">", "<=", ">="], 5), "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "as": 12,
}
_RIGHT = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="])
_COMPARE = frozenset(["==", "!=", "<", ">", "<=", ">="])
_ITEM = frozenset("fn struct enum trait impl mod use const static type extern pub unsafe async".split())


def _doc(source: str, at: int, out: Tokens) -> int:
    return _comment(source, at, out) if source.startswith("/*", at) else (lambda e: len(source) if e < 0 else e)(source.find("\n", at))


def _comment(source: str, at: int, out: Tokens) -> int:
    depth, i = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(source, i):
        if m.start() < i:
            continue
        depth += 1 if m.group() == "/*" else -1
        i = m.end()
        if not depth:
            return i
    out.add("bad", "/*", at)
    return len(source)


def _raw(source: str, at: int, out: Tokens) -> int:
    quote = source.index('"', at)
    hashes = source.count("#", at, quote)
    end = source.find('"' + "#" * hashes, quote + 1)
    out.add("str" if end >= 0 else "bad", 'r"', at)
    return len(source) if end < 0 else end + 1 + hashes


_OWN = {"doc": _doc, "block": _comment, "raw": _raw}


class Rust(Parser):
    RESUME = frozenset(["fn", "struct", "enum", "trait", "impl", "mod", "use", "pub"])

    def __init__(self, source: str) -> None:
        if source.startswith("#!") and not re.match(r"#!\s*\[", source):
            end = source.find("\n")
            source = " " * (len(source) if end < 0 else end) + ("" if end < 0 else source[end:])
        super().__init__(source, scan(source, _TOKEN, _KEYWORDS, _OWN))
        self.plain = 0  # over 0 where a brace opens a block, not a struct literal

    def split(self, first: str) -> bool:
        """Takes ``first`` off the front of a longer operator, such as > off >>."""
        kind = self.k[self.i]
        if kind == first:
            self.i += 1
            return True
        if kind.startswith(first) and kind in (">>", ">=", ">>=", "<<", "<<=", "&&", "||", "<-"):
            self.k[self.i] = self.t[self.i] = kind[1:]
            return True
        return False

    def document(self) -> None:
        while not self.at("eof"):
            self.guarded(self.item)

    # -- items

    def attributes(self) -> None:
        while self.at("#"):
            self.skip()
            self.accept("!")
            if not self.at("["):
                self.fail("expected [")
            self.tree()

    def tree(self) -> None:
        """A balanced bracketed stretch of any tokens."""
        close = [self.OPENERS[self.skip()]]
        while close:
            kind = self.k[self.i]
            if kind in ("eof", "bad"):
                self.fail(f"expected {close[-1]}")
            self.i += 1
            if kind in self.OPENERS:
                close.append(self.OPENERS[kind])
            elif kind in (")", "]", "}"):
                if kind != close.pop():
                    self.i -= 1
                    self.fail("brackets do not match")

    def visibility(self) -> None:
        if self.accept("pub") and self.at("(") and self.ahead() in ("crate", "self", "super", "in"):
            self.tree()

    def item(self) -> None:
        self.attributes()
        if self.at("eof") :
            return
        if self.at("}"):
            self.fail("item expected")
        self.visibility()
        kind = self.k[self.i]
        if kind == "use":
            self.skip()
            self.use_tree()
            self.expect(";")
        elif kind == "mod":
            self.skip()
            self.expect("id")
            if not self.accept(";"):
                self.expect("{")
                self.items(self.item)
        elif kind == "struct" or (kind == "id" and self.t[self.i] == "union" and self.ahead() == "id"):
            self.skip()
            self.struct()
        elif kind == "enum":
            self.skip()
            self.expect("id")
            self.generics()
            self.where()
            self.expect("{")
            self.group("}", self.variant)
        elif kind == "type":
            self.skip()
            self.type_item()
        elif kind == "static":
            self.skip()
            self.accept("mut")
            self.constant()
        elif kind == "const" and self.ahead() not in ("fn", "unsafe", "async", "extern", "{"):
            self.skip()
            self.constant()
        elif kind in ("const", "async", "unsafe", "extern", "fn", "trait", "impl") or (kind == "id" and self.t[self.i] == "auto"):
            self.qualified()
        elif kind == "id" and self.t[self.i] == "macro_rules" and self.ahead() == "!":
            self.i += 2
            self.expect("id")
            brace = self.at("{")
            if not self.at("{", "(", "["):
                self.fail("expected {")
            self.tree()
            if not brace:
                self.expect(";")
        elif kind in ("id", "crate", "self", "super", "::"):
            self.path(False)
            self.expect("!")
            brace = self.at("{")
            if not self.at("{", "(", "["):
                self.fail("expected {")
            self.tree()
            if not brace:
                self.expect(";")
        else:
            self.fail("item expected")

    def items(self, item) -> None:
        """Items up to the closing brace."""
        while not self.accept("}"):
            if self.at("eof"):
                self.fail("expected }")
            if self.at("#") and self.ahead() == "!":
                self.attributes()
                continue
            item()

    def use_tree(self) -> None:
        self.accept("::")
        while True:
            if self.accept("*"):
                return
            if self.accept("{"):
                self.group("}", self.use_tree)
                return
            if not self.at("id", "crate", "self", "super", "Self"):
                self.fail("path expected")
            self.skip()
            if not self.accept("::"):
                break
        if self.accept("as"):
            self.expect("id")

    def struct(self) -> None:
        self.expect("id")
        self.generics()
        self.where()
        if self.accept(";"):
            return
        if self.accept("("):
            self.group(")", self.tuple_field)
            self.where()
            self.expect(";")
        else:
            self.expect("{")
            self.group("}", self.field)

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.expect("id")
        self.expect(":")
        self.type()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.expect("id")
        if self.accept("("):
            self.group(")", self.tuple_field)
        elif self.accept("{"):
            self.group("}", self.field)
        if self.accept("="):
            self.expression()

    def type_item(self) -> None:
        self.expect("id")
        self.generics()
        if self.accept(":"):
            self.bounds()
        self.where()
        if self.accept("="):
            self.type()
        self.where()
        self.expect(";")

    def constant(self) -> None:
        self.expect("id")
        self.expect(":")
        self.type()
        if self.accept("="):
            self.expression()
        self.expect(";")

    def qualified(self) -> None:
        while True:
            if self.at("const", "async", "unsafe") or (self.at("id") and self.t[self.i] in ("auto", "default", "safe")):
                self.skip()
            elif self.accept("extern"):
                if self.accept("str") and self.at("{") or self.at("{"):
                    self.skip()
                    self.items(self.member)
                    return
                if self.accept("crate"):
                    self.at("self") and self.skip() or self.expect("id")
                    if self.accept("as"):
                        self.expect("id")
                    self.expect(";")
                    return
            else:
                break
        if self.accept("fn"):
            self.function()
        elif self.accept("trait"):
            self.expect("id")
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            self.expect("{")
            self.items(self.member)
        elif self.accept("impl"):
            if self.at("<"):
                self.generics()
            self.accept("const")
            self.accept("!")
            self.type()
            if self.accept("for"):
                self.type()
            self.where()
            self.expect("{")
            self.items(self.member)
        else:
            self.fail("item expected")

    def member(self) -> None:
        self.attributes()
        self.visibility()
        kind = self.k[self.i]
        if kind == "type":
            self.skip()
            self.type_item()
        elif kind == "const" and self.ahead() == "id":
            self.skip()
            self.constant()
        elif kind == "static":
            self.skip()
            self.accept("mut")
            self.constant()
        elif kind in ("fn", "const", "async", "unsafe", "extern") or (kind == "id" and self.t[self.i] in ("default", "safe")):
            while not self.at("fn"):
                if not self.at("const", "async", "unsafe", "extern", "str", "id"):
                    self.fail("expected fn")
                self.skip()
            self.skip()
            self.function()
        elif kind in ("id", "crate", "self", "::"):
            self.path(False)
            self.expect("!")
            brace = self.at("{")
            if not self.at("{", "(", "["):
                self.fail("expected {")
            self.tree()
            if not brace:
                self.expect(";")
        else:
            self.fail("member expected")

    def function(self) -> None:
        self.expect("id")
        self.generics()
        self.expect("(")
        self.group(")", self.parameter)
        if self.accept("->"):
            self.type()
        self.where()
        if not self.accept(";"):
            self.block()

    def parameter(self) -> None:
        self.attributes()
        if self.accept("..."):
            return
        start = self.i
        if self.split("&"):
            self.accept("life")
        self.accept("mut")
        if self.accept("self"):
            if self.accept(":"):
                self.type()
            return
        self.i = start
        self.pattern()
        self.expect(":")
        if not self.accept("..."):
            self.type()

    def generics(self) -> None:
        if not self.split("<"):
            return
        while not self.split(">"):
            self.attributes()
            if self.accept("life"):
                if self.accept(":"):
                    self.bounds()
            elif self.accept("const"):
                self.expect("id")
                self.expect(":")
                self.type()
                if self.accept("="):
                    self.generic_argument()
            else:
                self.expect("id")
                if self.accept(":"):
                    self.bounds()
                if self.accept("="):
                    self.type()
            if not self.accept(",") and not self.k[self.i].startswith(">"):
                self.fail("expected >")

    def where(self) -> None:
        if not self.accept("where"):
            return
        while not self.at("{", ";", "=", "eof"):
            if self.accept("life"):
                self.expect(":")
                self.bounds()
            else:
                self.for_lifetimes()
                self.type()
                self.expect(":")
                self.bounds()
            if not self.accept(","):
                return

    def for_lifetimes(self) -> None:
        if self.accept("for"):
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.accept("life"):
                pass
            elif self.at("(", "?", "~", "for", "id", "crate", "self", "super", "Self", "::", "async", "const"):
                wrapped = self.accept("(")
                self.accept("?")
                self.accept("~") and self.expect("const")
                self.accept("async")
                self.accept("const")
                self.for_lifetimes()
                if self.at("id") and self.t[self.i] == "use" :
                    self.skip()
                self.path(True)
                if wrapped:
                    self.expect(")")
            elif self.at("use"):
                self.skip()
                self.generics()
            else:
                return
            if not self.accept("+"):
                return

    # -- types and paths

    def type(self) -> None:
        kind = self.k[self.i]
        if kind in ("id", "crate", "self", "super", "Self", "::", "<", "<<"):
            self.path(True)
            if self.at("!") and self.ahead() in self.OPENERS:
                self.skip()
                self.tree()
        elif kind in ("&", "&&"):
            self.split("&")
            if kind == "&&":
                return self.type()
            self.accept("life")
            self.accept("mut")
            self.type()
        elif kind == "*":
            self.skip()
            if not self.accept("const"):
                self.expect("mut")
            self.type()
        elif kind == "[":
            self.skip()
            self.type()
            if self.accept(";"):
                self.expression()
            self.expect("]")
        elif kind == "(":
            self.skip()
            self.group(")", self.type)
        elif kind == "!":
            self.skip()
            return
        elif kind in ("dyn", "impl"):
            self.skip()
            self.bounds()
        elif kind in ("fn", "unsafe", "extern", "for"):
            self.for_lifetimes()
            if self.at("id", "crate", "::"):
                return self.path(True)
            self.accept("unsafe")
            if self.accept("extern"):
                self.accept("str")
            self.expect("fn")
            self.expect("(")
            self.group(")", self.fn_parameter)
            if self.accept("->"):
                self.type()
        elif kind == "id" or (kind == "id" and self.t[self.i] == "_"):
            self.skip()
        else:
            self.fail("type expected")

    def fn_parameter(self) -> None:
        self.attributes()
        if self.accept("..."):
            return
        if self.at("id") and self.ahead() == ":":
            self.i += 2
        self.type()

    def path(self, types: bool) -> None:
        """A path; with ``types`` generic arguments need no ::."""
        if self.split("<"):
            self.type()
            if self.accept("as"):
                self.type()
            if not self.split(">"):
                self.fail("expected >")
            self.expect("::")
        else:
            self.accept("::")
        while True:
            if not self.at("id", "crate", "self", "super", "Self"):
                self.fail("path expected")
            self.skip()
            if types:
                if self.k[self.i] in ("<", "<<"):
                    self.arguments()
                elif self.at("("):
                    self.skip()
                    self.group(")", self.type)
                    if self.accept("->"):
                        self.type()
            if not self.at("::"):
                return
            self.skip()
            if self.k[self.i] in ("<", "<<"):
                self.arguments()
                if not self.accept("::"):
                    return

    def arguments(self) -> None:
        self.split("<")
        while not self.split(">"):
            self.generic_argument()
            if not self.accept(",") and not self.k[self.i].startswith(">"):
                self.fail("expected >")

    def generic_argument(self) -> None:
        if self.accept("life") or self.at("num", "str", "char", "true", "false") and self.skip():
            return
        if self.at("-"):
            self.skip()
            self.expect("num")
            return
        if self.at("{"):
            return self.block()
        self.type()
        if self.accept("="):
            self.generic_argument()
        elif self.accept(":"):
            self.bounds()

    # -- patterns

    def pattern(self) -> None:
        self.split("|")
        self.single_pattern()
        while self.at("|"):
            self.skip()
            self.single_pattern()

    def single_pattern(self) -> None:
        kind = self.k[self.i]
        if kind in ("num", "str", "char", "true", "false", "-"):
            self.pattern_literal()
            self.pattern_range()
        elif kind in ("..", "..="):
            self.skip()
            if self.at("num", "char", "-", "id"):
                self.pattern_end()
        elif kind in ("&", "&&"):
            self.skip()
            self.accept("mut")
            self.single_pattern()
        elif kind == "(":
            self.skip()
            self.group(")", self.pattern)
        elif kind == "[":
            self.skip()
            self.group("]", self.pattern)
        elif kind in ("ref", "mut"):
            self.accept("ref")
            self.accept("mut")
            self.expect("id")
            if self.accept("@"):
                self.single_pattern()
        elif kind == "const" and self.ahead() == "{":
            self.skip()
            self.block()
        elif kind in ("id", "crate", "self", "super", "Self", "::", "<", "<<"):
            if kind == "id" and self.ahead() == "@":
                self.i += 2
                return self.single_pattern()
            self.path(False)
            if self.accept("!"):
                if not self.at("(", "[", "{"):
                    self.fail("expected (")
                self.tree()
            elif self.accept("("):
                self.group(")", self.pattern)
            elif self.at("{") :
                self.skip()
                self.group("}", self.field_pattern)
            else:
                self.pattern_range()
        else:
            self.fail("pattern expected")

    def pattern_literal(self) -> None:
        self.accept("-")
        if not self.at("num", "str", "char", "true", "false"):
            self.fail("literal expected")
        self.skip()

    def pattern_range(self) -> None:
        if self.at("..=", "...") or self.at(".."):
            self.skip()
            if self.at("num", "char", "-", "id", "crate", "Self"):
                self.pattern_end()

    def pattern_end(self) -> None:
        if self.at("num", "char", "-"):
            self.pattern_literal()
        else:
            self.path(False)

    def field_pattern(self) -> None:
        self.attributes()
        if self.accept(".."):
            if not self.at("}"):
                self.fail("expected }")
            return
        if self.at("id", "num") and self.ahead() == ":":
            self.i += 2
            self.pattern()
        else:
            self.accept("ref")
            self.accept("mut")
            self.expect("id")

    # -- statements and expressions

    def block(self) -> None:
        self.expect("{")
        outer, self.plain = self.plain, 0
        while not self.accept("}"):
            if self.at("eof"):
                self.fail("expected }")
            self.statement()
        self.plain = outer

    def statement(self) -> None:
        if self.accept(";"):
            return
        if self.at("#"):
            self.attributes()
            if self.at("}"):
                return
        kind = self.k[self.i]
        if kind == "let":
            self.skip()
            self.pattern()
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.expression()
                if self.accept("else"):
                    self.block()
            self.expect(";")
            return
        if kind in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "static", "type", "pub", "extern"):
            return self.item()
        if kind == "const" and self.ahead() != "{":
            return self.item()
        if kind in ("unsafe", "async") and self.ahead() in ("fn", "impl", "trait", "extern"):
            return self.item()
        if kind == "id" and self.t[self.i] == "macro_rules" and self.ahead() == "!":
            return self.item()
        blocklike = kind in ("if", "match", "while", "loop", "for", "unsafe", "{") or (kind == "life" and self.ahead() == ":") or (kind == "async" and self.ahead() in ("{", "move") and self.ahead(2) != "|") or (kind == "const" and self.ahead() == "{")
        if blocklike:
            self.operand_head()
            if self.at(".", "?"):
                self.postfix()
                self.climb_rest(1)
            elif self.at("=", "as") :
                self.climb_rest(1)
            else:
                self.accept(";")
                return
        elif kind == "id" and self.ahead() == "!" and self.ahead(2) == "{":
            self.i += 2
            self.tree()
            if self.at(".", "?"):
                self.postfix()
                self.climb_rest(1)
            elif not self.at("}"):
                self.accept(";")
                return
        else:
            self.expression()
        if not self.at("}"):
            self.expect(";")

    def climb_rest(self, least: int) -> None:
        """The operators and right sides after an operand already parsed."""
        self.climb(least, lambda: None, _LEVEL, _RIGHT, self.special) if self.k[self.i] in _LEVEL else None

    def expression(self) -> None:
        self.climb(1, self.unary, _LEVEL, _RIGHT, self.special)

    def special(self, kind: str, level: int) -> bool:
        if kind == "as":
            self.skip()
            self.type()
            return True
        if kind in ("..", "..="):
            self.skip()
            if self.starts_operand():
                self.climb(3, self.unary, _LEVEL, _RIGHT, self.special)
            elif kind == "..=":
                self.fail("expression expected")
            return True
        self.skip()
        self.climb(level if kind in _RIGHT else level + 1, self.unary, _LEVEL, _RIGHT, self.special)
        if kind in _COMPARE and self.k[self.i] in _COMPARE:
            self.fail("comparisons can't be chained")
        return True

    def starts_operand(self) -> bool:
        kind = self.k[self.i]
        if kind == "{":
            return not self.plain
        return kind in ("id", "num", "str", "char", "true", "false", "(", "[", "-", "!", "*", "&", "&&", "|", "||", "self", "Self", "crate", "super", "::", "<", "if", "match", "unsafe", "loop", "while", "for", "move", "return", "break", "continue", "life", "async", "const")

    def unary(self) -> None:
        while True:
            kind = self.k[self.i]
            if kind in ("-", "!", "*"):
                self.skip()
            elif kind in ("&", "&&"):
                self.skip()
                if self.at("id") and self.t[self.i] == "raw" and self.ahead() in ("const", "mut"):
                    self.skip()
                    self.skip()
                self.accept("mut")
            else:
                break
        if self.at("..", "..="):
            self.skip()
            if self.starts_operand():
                self.climb(3, self.unary, _LEVEL, _RIGHT, self.special)
            return
        self.operand_head()
        self.postfix()

    def nested(self, item) -> None:
        outer, self.plain = self.plain, 0
        item()
        self.plain = outer

    def condition(self) -> None:
        self.plain += 1
        self.expression()
        self.plain -= 1

    def operand_head(self) -> None:
        kind = self.k[self.i]
        if kind in ("num", "str", "char", "true", "false"):
            self.skip()
        elif kind in ("id", "crate", "self", "super", "Self", "::", "<", "<<"):
            self.path(False)
            if self.at("!") and self.ahead() in self.OPENERS:
                self.skip()
                self.tree()
            elif self.at("{") and not self.plain and self.is_struct_literal():
                self.skip()
                self.nested(lambda: self.group("}", self.field_value))
        elif kind == "(":
            self.skip()
            self.nested(lambda: self.group(")", self.attributed))
        elif kind == "[":
            self.skip()
            self.nested(self.array)
        elif kind == "{":
            self.block()
        elif kind == "unsafe":
            self.skip()
            self.block()
        elif kind == "const":
            self.skip()
            if self.at("|", "||", "move", "async"):
                return self.operand_head()
            self.block()
        elif kind == "async":
            self.skip()
            self.accept("move")
            if self.at("|", "||"):
                return self.closure()
            self.block()
        elif kind in ("|", "||", "move", "static"):
            self.accept("static")
            self.accept("move")
            self.closure()
        elif kind == "if":
            self.skip()
            self.condition()
            self.block()
            if self.accept("else"):
                if self.at("if"):
                    self.operand_head()
                else:
                    self.block()
        elif kind == "let":
            self.skip()
            self.pattern()
            self.expect("=")
            self.climb(5, self.unary, _LEVEL, _RIGHT, self.special)
        elif kind == "match":
            self.skip()
            self.condition()
            self.expect("{")
            self.nested(self.arms)
        elif kind == "while":
            self.skip()
            self.condition()
            self.block()
        elif kind == "loop":
            self.skip()
            self.block()
        elif kind == "for":
            self.skip()
            if self.at("<"):
                self.generics()
                return self.closure()
            self.pattern()
            self.expect("in")
            self.condition()
            self.block()
        elif kind == "life":
            self.skip()
            self.expect(":")
            if not self.at("loop", "while", "for", "{"):
                self.fail("loop expected")
            self.operand_head()
        elif kind == "return" or kind == "break":
            self.skip()
            if kind == "break":
                self.accept("life")
            if self.starts_operand():
                self.expression()
        elif kind == "continue":
            self.skip()
            self.accept("life")
        else:
            self.fail("expression expected")

    def attributed(self) -> None:
        self.attributes()
        self.expression()

    def is_struct_literal(self) -> bool:
        a, b = self.ahead(1), self.ahead(2)
        return a == "}" or a == ".." or a == "#" or (a in ("id", "num") and b in (":", ",", "}"))

    def field_value(self) -> None:
        self.attributes()
        if self.accept(".."):
            if not self.at("}"):
                self.expression()
            return
        if not self.at("id", "num"):
            self.fail("field expected")
        self.skip()
        if self.accept(":"):
            self.expression()

    def array(self) -> None:
        if self.accept("]"):
            return
        self.attributed()
        if self.accept(";"):
            self.expression()
            self.expect("]")
        elif self.accept(","):
            self.group("]", self.attributed)
        else:
            self.expect("]")

    def arms(self) -> None:
        while not self.accept("}"):
            self.attributes()
            self.pattern()
            if self.accept("if"):
                self.expression()
            self.expect("=>")
            blocklike = self.at("{")
            start = self.i
            if blocklike:
                self.block()
                if not self.at(",", "}") and self.at(".", "?", "as", "+", "=="):
                    self.i = start
                    self.expression()
                    blocklike = False
            else:
                self.expression()
            if not self.accept(",") and not blocklike and not self.at("}"):
                if self.k[self.i - 1] != "}":
                    self.fail("expected ,")

    def closure(self) -> None:
        if not self.accept("||"):
            self.expect("|")
            while not self.accept("|"):
                self.attributes()
                self.single_pattern()
                if self.accept(":"):
                    self.type()
                if not self.accept(",") and not self.at("|"):
                    self.fail("expected |")
        if self.accept("->"):
            self.type()
            self.block()
        else:
            self.expression()

    def postfix(self) -> None:
        while True:
            kind = self.k[self.i]
            if kind == "?":
                self.skip()
            elif kind == ".":
                self.skip()
                if self.at("await"):
                    self.skip()
                elif self.at("num"):
                    self.skip()
                else:
                    self.expect("id")
                    if self.at("::"):
                        self.skip()
                        self.arguments()
                        if not self.at("("):
                            self.fail("expected (")
            elif kind == "(":
                self.skip()
                self.nested(lambda: self.group(")", self.attributed))
            elif kind == "[":
                self.skip()
                self.nested(self.expression)
                self.expect("]")
            else:
                return


def check(source: str) -> list[SyntaxIssue]:
    p = Rust(source)
    p.document()
    return p.issues
