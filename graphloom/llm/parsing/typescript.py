"""TypeScript."""

from __future__ import annotations

import re

from graphloom.llm.parsing.base import Panic, Parser, SyntaxIssue, Tokens

_TOKEN = re.compile(
    r"""(?P<ws>[\s﻿]+)
    |(?P<com>//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)n?(?![\w$]))
    |(?P<id>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*)
    |(?P<priv>\#[^\W\d][\w$]*)
    |(?P<op>\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|\+\+|--|\+=|-=|\*=|/=|%=|<<=|<<|<=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|&=|\|=|\^=|\?\.(?!\d)|[-+*/%&|^~!?:;,.<>=@()\[\]{}])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
# The reserved words.
_KEYWORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_BEFORE_REGEX = frozenset(["(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return", "typeof", "case", "do", "else", "in", "instanceof", "new", "void", "delete", "throw", "&&", "||", "??", "==", "===", "!=", "!==", "<", ">", "+", "-", "*", "%", "^", "~", "+=", "-=", "*=", "tpl_open", "..."])
_LEVEL = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, **dict.fromkeys(["==", "!=", "===", "!=="], 7),
    **dict.fromkeys(["<", ">", "<=", ">=", "in", "instanceof", "as", "satisfies"], 8), **dict.fromkeys(["<<", ">>", ">>>"], 9), "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="])
_MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor".split())


def _lex(source: str, at: int, out: Tokens, inside: bool) -> int:
    """Tokens from ``at``; within a template up to the brace that closes its ${."""
    gap, depth, n = False, 0, len(source)
    while at < n:
        c = source[at]
        if c == "`":
            at = _template(source, at, out, gap)
            gap = False
            continue
        if c == "/" and (not out.kind or out.kind[-1] in _BEFORE_REGEX) and (m := _REGEX.match(source, at)):
            out.add("regex", m.group(), at, gap)
            at, gap = m.end(), False
            continue
        m = _TOKEN.match(source, at)
        if m is None:
            out.add("bad", c, at, gap)
            at, gap = at + 1, False
            continue
        kind, text = m.lastgroup, m.group()
        if kind in ("ws", "com"):
            gap = gap or "\n" in text or "\r" in text
            at = m.end()
            continue
        if kind == "op":
            kind = text
            if inside:
                if text == "{":
                    depth += 1
                elif text == "}":
                    if not depth:
                        return at
                    depth -= 1
        elif kind == "id" and text in _KEYWORDS:
            kind = text
        out.add(kind, text, at, gap)
        at, gap = m.end(), False
    return at


def _template(source: str, at: int, out: Tokens, gap: bool) -> int:
    out.add("tpl_start", "`", at, gap)
    at += 1
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 2
        elif c == "`":
            out.add("tpl_end", "`", at)
            return at + 1
        elif c == "$" and source.startswith("${", at):
            out.add("tpl_open", "${", at)
            at = _lex(source, at + 2, out, True)
            if at >= len(source):
                return at
            out.add("tpl_close", "}", at)
            at += 1
        else:
            at += 1
    return at


def tokens(source: str) -> Tokens:
    out, at = Tokens(), 0
    if source.startswith("#!"):
        at = (source + "\n").index("\n")
    _lex(source, at, out, False)
    out.add("eof", "", len(source), True)
    return out


class TypeScript(Parser):
    RESUME = frozenset(["class", "function", "const", "export", "import", "if", "for", "while", "return", "switch", "try"])

    def __init__(self, source: str) -> None:
        super().__init__(source, tokens(source))
        self.no_in = 0
        self.close: dict[int, int] = {}
        opened: list[int] = []
        for i, kind in enumerate(self.k):
            if kind in self.OPENERS:
                opened.append(i)
            elif kind in (")", "]", "}") and opened:
                self.close[opened.pop()] = i

    def attempt(self, item) -> bool:
        """Runs ``item``; if it fails or is false, the cursor goes back."""
        start = self.i
        try:
            if item() is not False:
                return True
        except Panic:
            pass
        self.i = start
        return False

    def word(self, *words: str) -> bool:
        return self.k[self.i] == "id" and self.t[self.i] in words

    def name(self) -> None:
        """An identifier where reserved words are none."""
        self.expect("id")

    def any_name(self) -> None:
        if not (self.t[self.i] and (self.t[self.i][0].isalpha() or self.t[self.i][0] in "_$\\") and not self.at("str")):
            self.fail("name expected")
        self.skip()

    def is_name(self, n: int = 0) -> bool:
        j = min(self.i + n, len(self.t) - 1)
        return bool(self.t[j]) and self.k[j] not in ("str", "num", "bad") and (self.t[j][0].isalpha() or self.t[j][0] in "_$\\")

    def end(self) -> None:
        """The end of a statement: a semicolon, or where one is implied."""
        if not self.accept(";") and not self.at("}", "eof") and not self.g[self.i]:
            self.fail("expected ;")

    def document(self) -> None:
        while not self.at("eof"):
            self.guarded(self.statement)

    # -- statements

    def statement(self) -> None:
        kind = self.k[self.i]
        if kind == "{":
            self.block()
        elif kind == ";":
            self.skip()
        elif kind in ("var", "const"):
            if kind == "const" and self.ahead() == "enum":
                self.skip()
                return self.enum()
            self.variables()
            self.end()
        elif kind == "function":
            self.function(True)
        elif kind in ("class", "@"):
            self.class_(True)
        elif kind == "enum":
            self.enum()
        elif kind == "if":
            self.skip()
            self.condition()
            self.statement()
            if self.accept("else"):
                self.statement()
        elif kind == "for":
            self.for_()
        elif kind == "while":
            self.skip()
            self.condition()
            self.statement()
        elif kind == "do":
            self.skip()
            self.statement()
            self.expect("while")
            self.condition()
            self.accept(";")
        elif kind in ("return", "throw"):
            self.skip()
            if kind == "throw" and self.g[self.i]:
                self.fail("expression expected")
            if not self.at(";", "}", "eof") and not self.g[self.i]:
                self.expression()
            self.end()
        elif kind in ("break", "continue"):
            self.skip()
            if self.at("id") and not self.g[self.i]:
                self.skip()
            self.end()
        elif kind == "debugger":
            self.skip()
            self.end()
        elif kind == "switch":
            self.switch()
        elif kind == "try":
            self.skip()
            self.block()
            if self.accept("catch"):
                if self.accept("("):
                    self.binding()
                    if self.accept(":"):
                        self.type()
                    self.expect(")")
                self.block()
                if self.accept("finally"):
                    self.block()
            else:
                self.expect("finally")
                self.block()
        elif kind == "import" and self.ahead() not in ("(", "."):
            self.import_()
        elif kind == "export":
            self.export()
        elif kind == "id":
            self.word_statement()
        else:
            self.expression()
            self.end()

    def word_statement(self) -> None:
        word, nxt = self.t[self.i], self.ahead()
        if nxt == ":":
            self.i += 2
            return self.statement()
        near = not self.g[min(self.i + 1, len(self.g) - 1)]
        if word == "let" and (nxt in ("id", "[", "{")):
            self.variables()
            return self.end()
        if word == "async" and nxt == "function" and near:
            self.skip()
            return self.function(True)
        if word == "interface" and nxt == "id" and near:
            self.skip()
            self.name()
            self.type_parameters()
            if self.accept("extends"):
                self.type_list()
            return self.object_type()
        if word == "type" and nxt == "id" and near:
            self.skip()
            self.name()
            self.type_parameters()
            self.expect("=")
            self.type()
            return self.end()
        if word in ("namespace", "module") and nxt in ("id", "str") and near:
            self.skip()
            if not self.accept("str"):
                self.name()
                while self.accept("."):
                    self.name()
            if self.at("{"):
                return self.block()
            return self.end()
        if word == "declare" and near and nxt in ("id", "const", "var", "function", "class", "enum"):
            self.skip()
            if self.word("global") and self.ahead() == "{":
                self.skip()
                return self.block()
            return self.statement()
        if word == "abstract" and nxt == "class" and near:
            self.skip()
            return self.class_(True)
        self.expression()
        self.end()

    def block(self) -> None:
        self.expect("{")
        outer, self.no_in = self.no_in, 0
        while not self.accept("}"):
            if self.at("eof"):
                self.fail("expected }")
            self.statement()
        self.no_in = outer

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def variables(self) -> None:
        self.skip()
        while True:
            self.binding()
            self.accept("!")
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.assignment()
            if not self.accept(","):
                return

    def binding(self) -> None:
        if self.accept("["):
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.binding()
                if self.accept("="):
                    self.assignment()
                if not self.at("]"):
                    self.expect(",")
        elif self.accept("{"):
            self.group("}", self.binding_property)
        else:
            self.name()

    def binding_property(self) -> None:
        if self.accept("..."):
            return self.binding()
        if self.at("id") and self.ahead() in (",", "}", "="):
            self.skip()
        else:
            self.property_name()
            self.expect(":")
            self.binding()
        if self.accept("="):
            self.assignment()

    def property_name(self) -> None:
        if self.accept("["):
            self.assignment()
            self.expect("]")
        elif self.at("str", "num", "priv"):
            self.skip()
        else:
            self.any_name()

    def for_(self) -> None:
        self.skip()
        if self.word("await"):
            self.skip()
        self.expect("(")
        self.no_in += 1
        if self.at("var", "const") or (self.word("let") and self.ahead() in ("id", "[", "{")):
            self.variables()
        elif not self.at(";"):
            self.expression()
        self.no_in -= 1
        if self.word("of"):
            self.skip()
            self.assignment()
        elif self.accept("in"):
            self.expression()
        else:
            self.expect(";")
            if not self.at(";"):
                self.expression()
            self.expect(";")
            if not self.at(")"):
                self.expression()
        self.expect(")")
        self.statement()

    def switch(self) -> None:
        self.skip()
        self.condition()
        self.expect("{")
        while not self.accept("}"):
            if not self.accept("default"):
                self.expect("case")
                self.expression()
            self.expect(":")
            while not self.at("case", "default", "}"):
                if self.at("eof"):
                    self.fail("expected }")
                self.statement()

    def import_(self) -> None:
        self.skip()
        if self.accept("str"):
            return self.import_end()
        if self.word("type") and (self.ahead() in ("{", "*") or (self.ahead() == "id" and self.t[self.i + 1] != "from")):
            self.skip()
        if self.at("id"):
            self.skip()
            if self.accept("="):
                if self.word("require"):
                    self.skip()
                    self.expect("(")
                    self.expect("str")
                    self.expect(")")
                else:
                    self.name()
                    while self.accept("."):
                        self.name()
                return self.end()
            if not self.accept(","):
                return self.from_()
        if self.accept("*"):
            self.need("as")
            self.name()
        else:
            self.expect("{")
            self.group("}", self.specifier)
        self.from_()

    def need(self, word: str) -> None:
        if not self.word(word):
            self.fail(f"expected {word}")
        self.skip()

    def specifier(self) -> None:
        if self.word("type") and self.is_name(1) and self.t[self.i + 1] != "as":
            self.skip()
        self.accept("str") or self.any_name()
        if self.word("as"):
            self.skip()
            self.accept("str") or self.any_name()

    def from_(self) -> None:
        self.need("from")
        self.expect("str")
        self.import_end()

    def import_end(self) -> None:
        if (self.at("with") or self.word("assert")) and self.ahead() == "{":
            self.skip()
            self.object()
        self.end()

    def export(self) -> None:
        self.skip()
        if self.accept("default"):
            if self.at("function", "class", "@") or (self.word("async", "abstract") and self.ahead() in ("function", "class")):
                self.word("async", "abstract") and self.skip()
                return self.function(False) if self.at("function") else self.class_(False)
            if self.word("interface"):
                return self.statement()
            self.assignment()
            return self.end()
        if self.accept("="):
            self.expression()
            return self.end()
        if self.word("as") and self.ahead() == "id":
            self.i += 2
            self.name()
            return self.end()
        if self.word("type") and self.ahead() in ("{", "*"):
            self.skip()
        if self.accept("*"):
            if self.word("as"):
                self.skip()
                self.any_name()
            return self.from_()
        if self.accept("{"):
            self.group("}", self.specifier)
            if self.word("from"):
                return self.from_()
            return self.end()
        if self.at("import"):
            return self.import_()
        if self.at("var", "const", "function", "class", "enum", "@") or self.word("let", "async", "interface", "type", "namespace", "module", "declare", "abstract"):
            return self.statement()
        self.fail("declaration expected")

    def enum(self) -> None:
        self.expect("enum")
        self.name()
        self.expect("{")
        self.group("}", self.enum_member)

    def enum_member(self) -> None:
        self.property_name()
        if self.accept("="):
            self.assignment()

    # -- functions and classes

    def function(self, named: bool) -> None:
        self.expect("function")
        self.accept("*")
        if named or self.at("id"):
            self.name()
        self.signature()
        if self.at("{"):
            self.block()
        else:
            self.end()

    def signature(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.accept(":"):
            self.return_type()

    def parameters(self) -> None:
        self.expect("(")
        self.group(")", self.parameter)

    def parameter(self) -> None:
        self.decorators()
        while self.word("public", "private", "protected", "readonly", "override") and (self.ahead() in ("id", "{", "[")):
            self.skip()
        self.accept("...")
        if self.accept("this"):
            pass
        else:
            self.binding()
        self.accept("?")
        if self.accept(":"):
            self.type()
        if self.accept("="):
            self.assignment()

    def decorators(self) -> None:
        while self.accept("@"):
            if self.accept("("):
                self.expression()
                self.expect(")")
            else:
                self.any_name()
                while self.accept("."):
                    self.any_name()
            if self.at("("):
                self.call()

    def class_(self, named: bool) -> None:
        self.decorators()
        if self.at("export"):
            return self.export()
        if self.word("abstract"):
            self.skip()
        self.expect("class")
        if (self.at("id") and not self.word("implements")) or named:
            self.name()
        self.type_parameters()
        if self.accept("extends"):
            self.left_side()
            if self.at("<"):
                self.type_arguments()
        if self.word("implements"):
            self.skip()
            self.type_list()
        self.expect("{")
        while not self.accept("}"):
            if self.accept(";"):
                continue
            if self.at("eof"):
                self.fail("expected }")
            self.member()

    def member(self) -> None:
        self.decorators()
        while self.at("id") and self.t[self.i] in _MODIFIERS and self.ahead() not in ("(", "=", ";", ":", "?", "!", "<", "}", ","):
            if self.t[self.i] == "static" and self.ahead() == "{":
                self.skip()
                return self.block()
            self.skip()
        self.accept("*")
        if self.word("get", "set") and self.ahead() not in ("(", "=", ";", ":", "?", "!", "<", "}", ","):
            self.skip()
        if self.at("[") and self.ahead() == "id" and self.ahead(2) == ":":
            self.index_signature()
            return self.end()
        self.property_name()
        self.accept("?") or self.accept("!")
        if self.at("(", "<"):
            self.signature()
            if self.at("{"):
                self.block()
            else:
                self.end()
            return
        if self.accept(":"):
            self.type()
        if self.accept("="):
            self.assignment()
        self.end()

    # -- types

    def type_parameters(self) -> None:
        if not self.accept("<"):
            return
        while not self.accept(">"):
            while self.at("const", "in") or self.word("out") and self.ahead() == "id":
                self.skip()
            self.name()
            if self.accept("extends"):
                self.type()
            if self.accept("="):
                self.type()
            if not self.at(">"):
                self.expect(",")

    def type_arguments(self) -> None:
        self.expect("<")
        self.type()
        while self.accept(","):
            self.type()
        self.expect(">")

    def type_list(self) -> None:
        self.type()
        while self.accept(","):
            self.type()

    def return_type(self) -> None:
        if self.word("asserts") and (self.ahead() in ("id", "this")) and not self.g[self.i + 1]:
            self.i += 2
            if self.word("is"):
                self.skip()
                self.type()
            return
        if self.at("id", "this") and self.ahead() == "id" and self.t[self.i + 1] == "is" and not self.g[self.i + 1]:
            self.i += 2
        self.type()

    def type(self) -> None:
        opens = self.at("(") and (close := self.close.get(self.i)) is not None and self.k[close + 1] == "=>"
        if opens or self.at("<", "new") or (self.word("abstract") and self.ahead() == "new"):
            if self.attempt(self.function_type):
                return
        self.union_type()
        if self.at("extends") and not self.g[self.i]:
            self.skip()
            self.union_type()
            self.expect("?")
            self.type()
            self.expect(":")
            self.type()

    def function_type(self) -> None:
        self.word("abstract") and self.skip()
        self.accept("new")
        self.type_parameters()
        self.parameters()
        self.expect("=>")
        self.return_type()

    def union_type(self) -> None:
        self.accept("|") or self.accept("&")
        while True:
            self.prefix_type()
            if not (self.accept("|") or self.accept("&")):
                return

    def prefix_type(self) -> None:
        if self.word("keyof", "readonly", "unique") and (self.ahead() in ("id", "typeof", "(", "[", "{", "str", "this", "import")) and not self.g[self.i + 1]:
            self.skip()
            return self.prefix_type()
        if self.word("infer") and self.ahead() == "id":
            self.i += 2
            if self.at("extends"):
                self.attempt(self.infer_bound)
            return
        self.primary_type()
        while not self.g[self.i]:
            if self.accept("["):
                if not self.accept("]"):
                    self.type()
                    self.expect("]")
            else:
                return

    def infer_bound(self) -> bool:
        self.expect("extends")
        self.union_type()
        return not self.at("?")

    def primary_type(self) -> None:
        kind = self.k[self.i]
        if kind in ("id", "void", "null", "this"):
            self.skip()
            while self.at("."):
                self.skip()
                self.any_name()
            if self.at("<") and not self.g[self.i]:
                self.type_arguments()
        elif kind in ("str", "num", "true", "false"):
            self.skip()
        elif kind == "-":
            self.skip()
            self.expect("num")
        elif kind == "tpl_start":
            self.skip()
            while self.accept("tpl_open"):
                self.type()
                self.expect("tpl_close")
            self.expect("tpl_end")
        elif kind == "(":
            self.skip()
            self.type()
            self.expect(")")
        elif kind == "[":
            self.skip()
            self.group("]", self.tuple_item)
        elif kind == "{":
            if not self.attempt(self.mapped_type):
                self.object_type()
        elif kind == "typeof":
            self.skip()
            if self.at("import"):
                return self.primary_type()
            self.at("this") and self.skip() or self.any_name()
            while self.accept("."):
                self.any_name()
            if self.at("<") and not self.g[self.i]:
                self.type_arguments()
        elif kind == "import":
            self.skip()
            self.expect("(")
            self.type()
            self.expect(")")
            while self.accept("."):
                self.any_name()
            if self.at("<"):
                self.type_arguments()
        else:
            self.fail("type expected")

    def tuple_item(self) -> None:
        self.accept("...")
        if self.at("id") and (self.ahead() == ":" or (self.ahead() == "?" and self.ahead(2) == ":")):
            self.skip()
            self.accept("?")
            self.skip()
        self.type()
        self.accept("?")

    def mapped_type(self) -> None:
        self.expect("{")
        self.accept("+") or self.accept("-")
        self.word("readonly") and self.skip()
        self.expect("[")
        self.name()
        self.expect("in")
        self.type()
        if self.word("as"):
            self.skip()
            self.type()
        self.expect("]")
        self.accept("+") or self.accept("-")
        self.accept("?")
        if self.accept(":"):
            self.type()
        self.accept(";")
        self.expect("}")

    def object_type(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            self.type_member()
            if not self.accept(";") and not self.accept(",") and not self.at("}") and not self.g[self.i]:
                self.fail("expected ;")

    def index_signature(self) -> None:
        self.expect("[")
        self.name()
        self.expect(":")
        self.type()
        self.expect("]")
        self.accept("?")
        if self.accept(":"):
            self.type()

    def type_member(self) -> None:
        if self.at("(", "<"):
            return self.signature()
        if self.at("new") and self.ahead() in ("(", "<"):
            self.skip()
            return self.signature()
        if self.word("readonly", "get", "set") and self.ahead() not in (":", "?", "(", ";", ",", "}", "<"):
            self.skip()
        if self.at("[") and self.ahead() == "id" and self.ahead(2) == ":":
            return self.index_signature()
        self.property_name()
        self.accept("?")
        if self.at("(", "<"):
            return self.signature()
        if self.accept(":"):
            self.type()

    # -- expressions

    def expression(self) -> None:
        self.assignment()
        while self.accept(","):
            self.assignment()

    def arrow(self) -> bool:
        """An arrow function, if the tokens ahead are one."""
        kind = self.k[self.i]
        start = self.i
        if kind == "id" and self.t[self.i] == "async" and self.ahead() in ("id", "(", "<") and not self.g[self.i + 1]:
            if self.ahead() == "id" and self.ahead(2) != "=>":
                return False
            self.skip()
            kind = self.k[self.i]
        if kind == "id" and self.ahead() == "=>":
            self.i += 2
            self.arrow_body()
            return True
        if kind == "(":
            close = self.close.get(self.i)
            after = self.k[close + 1] if close is not None else "eof"
            if after == "=>" or after == ":":
                if self.attempt(self.arrow_head):
                    self.arrow_body()
                    return True
                if after == "=>":
                    self.arrow_head()
        elif kind == "<":
            if self.attempt(self.arrow_head):
                self.arrow_body()
                return True
        self.i = start
        return False

    def arrow_head(self) -> None:
        self.signature()
        if self.g[self.i]:
            self.fail("expected => on the line")
        self.expect("=>")

    def arrow_body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.assignment()

    def assignment(self) -> None:
        if self.at("id", "(", "<") and self.arrow():
            return
        if self.word("yield") and self.ahead() not in (".", "=", ")", ",", ";", "=>"):
            self.skip()
            if not self.g[self.i]:
                self.accept("*")
                if not self.at(")", "]", "}", ",", ";", "eof"):
                    self.assignment()
            return
        self.binary(1)
        if self.accept("?"):
            outer, self.no_in = self.no_in, 0
            self.assignment()
            self.no_in = outer
            self.expect(":")
            self.assignment()
            return
        op, width = self.operator()
        if op in _ASSIGN:
            self.i += width
            self.assignment()

    def operator(self) -> tuple[str, int]:
        """The operator at the cursor, with adjoining > and = joined, and its number of tokens."""
        op = self.k[self.i]
        if op == ">":
            n, at = 1, self.p[self.i]
            while n < 4 and self.ahead(n) in (">", "=") and self.p[self.i + n] == at + n and not op.endswith("="):
                op += self.k[self.i + n]
                n += 1
            return op, n
        if op == "id" and self.t[self.i] in ("as", "satisfies") and not self.g[self.i]:
            return self.t[self.i], 1
        return op, 1

    def binary(self, least: int) -> None:
        self.unary()
        while True:
            op, width = self.operator()
            level = _LEVEL.get(op)
            if level is None or level < least or (op == "in" and self.no_in):
                return
            self.i += width
            if op in ("as", "satisfies"):
                if not self.accept("const"):
                    self.type()
            else:
                self.binary(level if op == "**" else level + 1)

    def unary(self) -> None:
        kind = self.k[self.i]
        if kind in ("+", "-", "!", "~", "typeof", "void", "delete", "++", "--"):
            self.skip()
            return self.unary()
        if kind == "id" and self.t[self.i] == "await" and (self.ahead() in ("id", "(", "[", "{", "new", "this", "super", "import", "str", "num", "tpl_start", "function", "class", "null", "regex", "!", "-", "+")) and not self.g[self.i + 1]:
            self.skip()
            return self.unary()
        if kind == "<":
            self.type_arguments()
            return self.unary()
        self.left_side()
        if self.at("++", "--") and not self.g[self.i]:
            self.skip()

    def left_side(self) -> None:
        if self.at("new"):
            self.skip()
            if self.accept("."):
                self.need("target")
            else:
                self.new_target()
        elif self.at("import"):
            self.skip()
            if self.accept("."):
                self.any_name()
            else:
                self.call()
        else:
            self.primary()
        while True:
            kind = self.k[self.i]
            if kind == ".":
                self.skip()
                self.accept("priv") or self.any_name()
            elif kind == "?.":
                self.skip()
                if self.accept("["):
                    self.inner()
                elif self.at("("):
                    self.call()
                elif self.at("<"):
                    self.type_arguments()
                    self.call()
                else:
                    self.accept("priv") or self.any_name()
            elif kind == "[":
                self.skip()
                self.inner()
            elif kind == "(":
                self.call()
            elif kind == "tpl_start":
                self.template()
            elif kind == "!" and not self.g[self.i]:
                self.skip()
            elif kind == "<" and self.attempt(self.generic_call):
                continue
            else:
                return

    def inner(self) -> None:
        outer, self.no_in = self.no_in, 0
        self.expression()
        self.no_in = outer
        self.expect("]")

    def generic_call(self) -> bool:
        self.type_arguments()
        return self.at("(", "tpl_start", ")", "]", ",", ";", ".", "?.", "eof", "}", ":")

    def new_target(self) -> None:
        if self.at("new"):
            self.skip()
            self.new_target()
        else:
            self.primary()
        while True:
            if self.accept("."):
                self.any_name()
            elif self.accept("["):
                self.inner()
            else:
                break
        if self.at("<"):
            self.attempt(self.generic_call)
        if self.at("("):
            self.call()

    def call(self) -> None:
        self.expect("(")
        outer, self.no_in = self.no_in, 0
        self.group(")", self.argument)
        self.no_in = outer

    def argument(self) -> None:
        self.accept("...")
        self.assignment()

    def template(self) -> None:
        self.expect("tpl_start")
        while self.accept("tpl_open"):
            self.expression()
            self.expect("tpl_close")
        self.expect("tpl_end")

    def primary(self) -> None:
        kind = self.k[self.i]
        if kind == "id" and self.t[self.i] == "async" and self.ahead() == "function" and not self.g[self.i + 1]:
            self.skip()
            self.function(False)
        elif kind in ("id", "num", "str", "regex", "this", "super", "null", "true", "false"):
            self.skip()
        elif kind == "priv" and self.ahead() == "in":
            self.skip()
        elif kind == "tpl_start":
            self.template()
        elif kind == "(":
            self.skip()
            outer, self.no_in = self.no_in, 0
            self.expression()
            self.no_in = outer
            self.expect(")")
        elif kind == "[":
            self.skip()
            outer, self.no_in = self.no_in, 0
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.argument()
                if not self.at("]"):
                    self.expect(",")
            self.no_in = outer
        elif kind == "{":
            outer, self.no_in = self.no_in, 0
            self.object()
            self.no_in = outer
        elif kind == "function":
            self.function_expression()
        elif kind in ("class", "@"):
            self.class_(False)
        else:
            self.fail("expression expected")

    def function_expression(self) -> None:
        self.expect("function")
        self.accept("*")
        self.accept("id")
        self.signature()
        self.block()

    def object(self) -> None:
        self.expect("{")
        self.group("}", self.property)

    def property(self) -> None:
        if self.accept("..."):
            return self.assignment()
        while self.word("async", "get", "set") and self.ahead() not in (",", "}", ":", "(", "<", "="):
            self.skip()
        star = self.accept("*")
        plain = self.at("id")
        self.property_name()
        if self.at("(", "<"):
            self.signature()
            self.block()
        elif star:
            self.fail("expected (")
        elif self.accept(":"):
            self.assignment()
        elif not plain:
            self.fail("expected :")
        elif self.accept("="):
            self.assignment()


def check(source: str) -> list[SyntaxIssue]:
    p = TypeScript(source)
    p.document()
    return p.issues
