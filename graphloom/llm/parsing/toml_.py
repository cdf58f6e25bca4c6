"""TOML 1.0."""

from __future__ import annotations

import re

from graphloom.llm.parsing.base import Panic, SyntaxIssue

_BARE = re.compile(r"[A-Za-z0-9_-]+")
_WS = re.compile(r"[ \t]*")
_SKIP = re.compile(r"(?:[ \t\n]|#[^\n\x00-\x08\x0a-\x1f\x7f]*)*")
_COMMENT = re.compile(r"#[^\n\x00-\x08\x0b-\x1f\x7f]*")
_BASIC = re.compile(r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
_LITERAL = re.compile(r"'[^'\x00-\x08\x0a-\x1f\x7f]*'")
_LONG_BASIC = re.compile(r'"""(?:[^"\\\x00-\x08\x0b-\x1f\x7f]|"{1,2}(?!")|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\n[ \t\n]*))*"{3,5}')
_LONG_LITERAL = re.compile(r"'''(?:[^'\x00-\x08\x0b-\x1f\x7f]|'{1,2}(?!'))*'{3,5}")
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
_SCALAR = re.compile(
    rf"(?:true|false"
    rf"|{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_TIME}"
    r"|0x[0-9A-Fa-f]+(?:_[0-9A-Fa-f]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*"
    r"|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w+.:-])"
)


class _Table:
    """What a name stands for: a table by header, by dotted key or implied, a list of tables, or a closed value."""

    __slots__ = ("sort", "names")

    def __init__(self, sort: str) -> None:
        self.sort, self.names = sort, {}


class Toml:
    def __init__(self, source: str) -> None:
        self.s, self.i, self.issues = source, 0, []
        self.root = self.here = _Table("header")

    def fail(self, cause: str) -> None:
        raise Panic(cause + (" before the end" if self.i >= len(self.s) else ""))

    def take(self, pattern: re.Pattern[str]) -> bool:
        m = pattern.match(self.s, self.i)
        if m and m.end() > self.i:
            self.i = m.end()
            return True
        return False

    def char(self, c: str) -> bool:
        if self.s.startswith(c, self.i):
            self.i += len(c)
            return True
        return False

    def key(self) -> list[str]:
        parts = []
        while True:
            self.take(_WS)
            start = self.i
            if self.take(_BARE):
                parts.append(self.s[start : self.i])
            elif self.take(_BASIC) or self.take(_LITERAL):
                parts.append(self.s[start + 1 : self.i - 1])
            else:
                self.fail("key expected")
            self.take(_WS)
            if not self.char("."):
                return parts

    def value(self) -> None:
        if self.s.startswith('"""', self.i):
            if not self.take(_LONG_BASIC):
                self.fail("string not closed")
        elif self.s.startswith("'''", self.i):
            if not self.take(_LONG_LITERAL):
                self.fail("string not closed")
        elif self.char("["):
            self.take(_SKIP)
            while not self.char("]"):
                self.value()
                self.take(_SKIP)
                if not self.char(","):
                    if not self.char("]"):
                        self.fail("expected ]")
                    return
                self.take(_SKIP)
        elif self.char("{"):
            inner = _Table("inline")
            self.take(_WS)
            if not self.char("}"):
                while True:
                    self.pair(inner)
                    self.take(_WS)
                    if self.char("}"):
                        break
                    if not self.char(","):
                        self.fail("expected }")
        elif not (self.take(_BASIC) or self.take(_LITERAL) or self.take(_SCALAR)):
            self.fail("value expected")

    def pair(self, into: _Table) -> None:
        *path, last = self.key()
        if not self.char("="):
            self.fail("expected =")
        self.take(_WS)
        self.value()
        for name in path:
            into = into.names.setdefault(name, _Table("dotted"))
            if into.sort not in ("dotted", "implied"):
                self.fail("name already has a value")
        if last in into.names:
            self.fail("name already has a value")
        into.names[last] = _Table("value")

    def header(self) -> None:
        many = self.char("[")
        *path, last = self.key()
        if not self.char("]]" if many else "]"):
            self.fail("expected ]")
        into = self.root
        for name in path:
            into = into.names.setdefault(name, _Table("implied"))
            if into.sort == "value":
                self.fail("name already has a value")
        old = into.names.get(last)
        if many:
            if old is not None and old.sort != "list":
                self.fail("name already has a value")
            self.here = into.names[last] = _Table("list")
        else:
            if old is not None and old.sort != "implied":
                self.fail("table declared twice")
            self.here = into.names[last] = old or _Table("header")
            self.here.sort = "header"

    def entry(self) -> None:
        if self.char("["):
            self.header()
        else:
            self.pair(self.here)
        self.take(_WS)
        self.take(_COMMENT)
        if self.i < len(self.s) and not self.char("\n"):
            self.fail("expected the end of the line")

    def document(self) -> list[SyntaxIssue]:
        while True:
            self.take(_SKIP)
            if self.i >= len(self.s):
                return self.issues
            try:
                self.entry()
            except Panic as e:
                self.issues.append(SyntaxIssue(self.s.count("\n", 0, self.i) + 1, str(e)))
                end = self.s.find("\n", self.i)
                self.i = len(self.s) if end < 0 else end + 1


def check(source: str) -> list[SyntaxIssue]:
    return Toml(source.replace("\r\n", "\n")).document()
