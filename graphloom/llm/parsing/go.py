"""Go."""

from __future__ import annotations

import re

from graphloom.llm.parsing.base import Parser, SyntaxIssue, Tokens

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r\n]+)
    |(?P<com>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`)
    |(?P<char>'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
    |(?P<num>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?![\w]))
    |(?P<id>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.X,
)
# The language's keywords.
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset(["id", "num", "str", "char", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_LEVEL = {"||": 1, "&&": 2, **dict.fromkeys(["==", "!=", "<", "<=", ">", ">="], 3), **dict.fromkeys(["+", "-", "|", "^"], 4), **dict.fromkeys(["*", "/", "%", "<<", ">>", "&", "&^"], 5)}
_ASSIGN = frozenset(["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="])


def tokens(source: str) -> Tokens:
    """Tokens with the semicolons that line ends insert."""
    out, at, n = Tokens(), 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        if m is None:
            out.add("bad", source[at], at)
            at += 1
            continue
        kind, text = m.lastgroup, m.group()
        if kind in ("ws", "com"):
            if ("\n" in text) and out.kind and out.kind[-1] in _ENDS:
                out.add(";", "\n", at)
            at = m.end()
            continue
        if kind == "op" or text in _KEYWORDS:
            kind = text
        out.add(kind, text, at)
        at = m.end()
    if out.kind and out.kind[-1] in _ENDS:
        out.add(";", "\n", n)
    out.add("eof", "", n)
    return out


class Go(Parser):
    RESUME = frozenset(["func", "type", "var", "const", "import"])

    def __init__(self, source: str) -> None:
        super().__init__(source, tokens(source))
        self.plain = 0  # over 0 where a brace opens a block, not a composite literal

    def document(self) -> None:
        self.guarded(self.package)
        while self.at("import"):
            self.guarded(lambda: self.ended(self.imports))
        while not self.at("eof"):
            self.guarded(lambda: self.ended(self.declaration))

    def ended(self, item) -> None:
        item()
        if not self.at("eof"):
            self.expect(";")

    def package(self) -> None:
        self.expect("package")
        self.expect("id")
        self.expect(";")

    def spec_list(self, spec) -> None:
        if self.accept("("):
            while not self.accept(")"):
                spec()
                if not self.at(")"):
                    self.expect(";")
        else:
            spec()

    def imports(self) -> None:
        self.expect("import")
        self.spec_list(self.import_spec)

    def import_spec(self) -> None:
        if self.at("id", "."):
            self.skip()
        self.expect("str")

    def declaration(self) -> None:
        kind = self.k[self.i]
        if kind == "func":
            self.function()
        elif kind in ("var", "const", "type"):
            self.simple_declaration()
        else:
            self.fail("declaration expected")

    def simple_declaration(self) -> None:
        kind = self.skip()
        self.spec_list({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[kind])

    def id_list(self) -> None:
        self.expect("id")
        while self.accept(","):
            self.expect("id")

    def var_spec(self) -> None:
        self.id_list()
        if not self.at("="):
            self.type()
            if not self.at("="):
                return
        self.expect("=")
        self.expressions()

    def const_spec(self) -> None:
        self.id_list()
        if not self.at("=", ";", ")"):
            self.type()
        if self.accept("="):
            self.expressions()

    def type_spec(self) -> None:
        self.expect("id")
        if self.at("[") and self.ahead() == "id" and self.ahead(2) != "]":
            start = self.i
            self.i += 1
            try:
                self.type_parameters()
            except Exception:
                self.i = start  # an array type whose length is an expression
        self.accept("=")
        self.type()

    def type_parameters(self) -> None:
        while not self.accept("]"):
            self.id_list()
            self.constraint()
            if not self.accept(",") and not self.at("]"):
                self.fail("expected ]")

    def constraint(self) -> None:
        self.accept("~")
        self.type()
        while self.accept("|"):
            self.accept("~")
            self.type()

    def function(self) -> None:
        self.expect("func")
        if self.at("("):
            self.parameters()
        self.expect("id")
        if self.accept("["):
            self.type_parameters()
        self.signature()
        if self.at("{"):
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.starts_type():
            self.type()

    def starts_type(self) -> bool:
        return self.at("id", "*", "[", "struct", "map", "chan", "func", "interface", "<-", "(")

    def parameters(self) -> None:
        self.expect("(")
        while not self.accept(")"):
            if not self.accept("..."):
                self.type()
                if self.accept("..."):
                    self.type()
                elif self.starts_type():
                    self.type()
            else:
                self.type()
            if not self.accept(",") and not self.at(")"):
                self.fail("expected )")

    def type(self) -> None:
        kind = self.k[self.i]
        if kind == "id":
            self.skip()
            if self.accept("."):
                self.expect("id")
            if self.at("[") and self.ahead() != "]":
                self.skip()
                self.type_list()
                self.expect("]")
        elif kind == "*":
            self.skip()
            self.type()
        elif kind == "(":
            self.skip()
            self.type()
            self.expect(")")
        elif kind == "[":
            self.skip()
            if not self.accept("]"):
                if not self.accept("..."):
                    self.nested(self.expression)
                self.expect("]")
            self.type()
        elif kind == "map":
            self.skip()
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif kind == "chan":
            self.skip()
            self.accept("<-")
            self.type()
        elif kind == "<-":
            self.skip()
            self.expect("chan")
            self.type()
        elif kind == "func":
            self.skip()
            self.signature()
        elif kind == "struct":
            self.skip()
            self.expect("{")
            while not self.accept("}"):
                self.field()
                if not self.at("}"):
                    self.expect(";")
        elif kind == "interface":
            self.skip()
            self.expect("{")
            while not self.accept("}"):
                if self.at("id") and self.ahead() == "(":
                    self.skip()
                    self.signature()
                else:
                    self.constraint()
                if not self.at("}"):
                    self.expect(";")
        else:
            self.fail("type expected")

    def type_list(self) -> None:
        self.type()
        while self.accept(","):
            if self.at("]"):
                return
            self.type()

    def field(self) -> None:
        if self.accept("*"):
            self.type()
        elif self.at("id") and self.ahead() in (";", "}", "str", "."):
            self.type()
        else:
            self.id_list()
            self.type()
        self.accept("str")

    def block(self) -> None:
        self.expect("{")
        outer, self.plain = self.plain, 0
        self.statements(("}",))
        self.plain = outer
        self.expect("}")

    def statements(self, stop: tuple[str, ...]) -> None:
        while not self.at("eof", *stop):
            if self.accept(";"):
                continue
            self.statement()
            if not self.at(*stop):
                self.expect(";")

    def statement(self) -> None:
        kind = self.k[self.i]
        if kind in ("var", "const", "type"):
            self.simple_declaration()
        elif kind == "{":
            self.block()
        elif kind == "if":
            self.if_statement()
        elif kind == "for":
            self.for_statement()
        elif kind == "switch":
            self.switch()
        elif kind == "select":
            self.skip()
            self.expect("{")
            while not self.accept("}"):
                if not self.accept("default"):
                    self.expect("case")
                    self.simple()
                self.expect(":")
                self.statements(("case", "default", "}"))
        elif kind == "return":
            self.skip()
            if not self.at(";", "}"):
                self.expressions()
        elif kind in ("break", "continue"):
            self.skip()
            self.accept("id")
        elif kind == "goto":
            self.skip()
            self.expect("id")
        elif kind == "fallthrough":
            self.skip()
        elif kind in ("go", "defer"):
            self.skip()
            self.expression()
        elif kind == "id" and self.ahead() == ":":
            self.i += 2
            if not self.at("}", ";"):
                self.statement()
        else:
            self.simple()

    def simple(self) -> None:
        self.expressions()
        kind = self.k[self.i]
        if kind in ("++", "--"):
            self.skip()
        elif kind in _ASSIGN:
            self.skip()
            if self.accept("range"):
                self.expression()
            else:
                self.expressions()
        elif kind == "<-":
            self.skip()
            self.expression()

    def header(self, item) -> None:
        self.plain += 1
        item()
        self.plain -= 1

    def if_statement(self) -> None:
        self.expect("if")

        def head() -> None:
            if not self.at(";"):
                self.simple()
            if self.accept(";"):
                self.simple()

        self.header(head)
        self.block()
        if self.accept("else"):
            if self.at("if"):
                self.if_statement()
            else:
                self.block()

    def for_statement(self) -> None:
        self.expect("for")

        def head() -> None:
            if self.at("{"):
                return
            if self.accept("range"):
                self.expression()
                return
            if not self.at(";"):
                self.simple()
            if self.accept(";"):
                if not self.at(";"):
                    self.expression()
                self.expect(";")
                if not self.at("{"):
                    self.simple()

        self.header(head)
        self.block()

    def switch(self) -> None:
        self.expect("switch")

        def head() -> None:
            if self.at("{"):
                return
            if not self.at(";"):
                self.simple()
            if self.accept(";") and not self.at("{"):
                self.simple()

        self.header(head)
        self.expect("{")
        while not self.accept("}"):
            if not self.accept("default"):
                self.expect("case")
                self.type_or_expression()
                while self.accept(","):
                    self.type_or_expression()
            self.expect(":")
            self.statements(("case", "default", "}"))

    def type_or_expression(self) -> None:
        if self.at("*", "[", "map", "chan", "interface", "struct"):
            start = self.i
            try:
                self.expression()
                return
            except Exception:
                self.i = start
            self.type()
        else:
            self.expression()

    def expressions(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def expression(self) -> None:
        self.climb(1, self.unary, _LEVEL)

    def nested(self, item) -> None:
        outer, self.plain = self.plain, 0
        item()
        self.plain = outer

    def unary(self) -> None:
        while self.at("+", "-", "!", "^", "*", "&", "<-", "~"):
            if self.at("<-") and self.ahead() == "chan":
                break
            self.skip()
        self.primary()

    def primary(self) -> None:
        kind = self.k[self.i]
        literal = False
        if kind in ("num", "str", "char"):
            self.skip()
        elif kind == "id":
            self.skip()
            literal = True
        elif kind == "(":
            self.skip()
            self.nested(self.type_or_expression)
            self.expect(")")
        elif kind == "func":
            self.skip()
            self.signature()
            if self.at("{"):
                self.block()
        elif kind in ("[", "map", "struct", "chan", "interface", "<-"):
            self.type()
            if self.at("{"):
                self.composite()
            elif not self.at("("):
                if not self.at(")", ","):
                    self.fail("expected {")
        else:
            self.fail("expression expected")
        while True:
            kind = self.k[self.i]
            if kind == ".":
                self.skip()
                if self.accept("("):
                    if not self.accept("type"):
                        self.type()
                    self.expect(")")
                    literal = False
                else:
                    self.expect("id")
            elif kind == "[":
                self.skip()
                self.nested(self.index)
                self.expect("]")
            elif kind == "(":
                self.skip()
                self.nested(self.call_arguments)
                literal = False
            elif kind == "{" and literal and not self.plain:
                self.composite()
                literal = False
            else:
                return

    def index(self) -> None:
        if not self.at(":"):
            self.type_or_expression()
        while self.at(":", ","):
            if self.skip() == ",":
                if not self.at("]"):
                    self.type()
            elif not self.at(":", "]"):
                self.expression()

    def call_arguments(self) -> None:
        while not self.accept(")"):
            self.type_or_expression()
            self.accept("...")
            if not self.accept(",") and not self.at(")"):
                self.fail("expected )")

    def composite(self) -> None:
        self.expect("{")
        self.nested(lambda: self.group("}", self.element))

    def element(self) -> None:
        self.element_value()
        if self.accept(":"):
            self.element_value()

    def element_value(self) -> None:
        if self.at("{"):
            self.composite()
        else:
            self.expression()


def check(source: str) -> list[SyntaxIssue]:
    p = Go(source)
    p.document()
    return p.issues
