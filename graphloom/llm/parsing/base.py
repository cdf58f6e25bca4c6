"""What the parsers share: token streams, errors, recovery and precedence climbing."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass


@dataclass(frozen=True)
class SyntaxIssue:
    line: int
    cause: str


class Panic(Exception):
    """Raised at an error; the statement loop records it and recovers."""


class Tokens:
    """Kinds, texts and positions; the kind of an operator or keyword is its text."""

    __slots__ = ("kind", "text", "pos", "gap")

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.pos: list[int] = []
        self.gap: list[bool] = []  # a line break stands before the token

    def add(self, kind: str, text: str, pos: int, gap: bool = False) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.pos.append(pos)
        self.gap.append(gap)


def scan(source: str, pattern: re.Pattern[str], keywords: frozenset[str], own: dict | None = None) -> Tokens:
    """Tokens by a pattern whose groups are ws, com, id, op and others; ``own`` maps a group to a function
    (source, start, tokens) -> end for what a pattern can't match. An unknown character has the kind ``bad``."""
    out, at, gap, n = Tokens(), 0, False, len(source)
    match = pattern.match
    while at < n:
        m = match(source, at)
        if m is None:
            out.add("bad", source[at], at, gap)
            at, gap = at + 1, False
            continue
        kind, text, end = m.lastgroup, m.group(), m.end()
        if kind == "ws" or kind == "com":
            gap = gap or "\n" in text or "\r" in text
            at = end
            continue
        if own is not None and kind in own:
            end = own[kind](source, at, out)
            gap = False
            at = end
            continue
        if kind == "op" or (kind == "id" and text in keywords):
            kind = text
        out.add(kind, text, at, gap)
        at, gap = end, False
    out.add("eof", "", n, True)
    return out


class Parser:
    """Cursor over tokens with the usual helpers; subclasses give ``unit`` and the places to resume at."""

    OPENERS = {"(": ")", "[": "]", "{": "}"}
    RESUME: frozenset[str] = frozenset()  # kinds that may start a statement

    def __init__(self, source: str, tokens: Tokens) -> None:
        self.source, self.k, self.t, self.p, self.g = source, tokens.kind, tokens.text, tokens.pos, tokens.gap
        self.i = 0
        self.issues: list[SyntaxIssue] = []
        self.breaks: list[int] | None = None  # where lines end, found at the first error

    def at(self, *kinds: str) -> bool:
        return self.k[self.i] in kinds

    def ahead(self, n: int = 1) -> str:
        j = self.i + n
        return self.k[j] if j < len(self.k) else "eof"

    def skip(self) -> str:
        kind = self.k[self.i]
        if kind != "eof":
            self.i += 1
        return kind

    def accept(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def expect(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {kind}")
        self.i += 1

    def fail(self, cause: str) -> None:
        if self.k[self.i] == "eof":
            cause += " before the end"
        raise Panic(cause)

    def line(self) -> int:
        if self.breaks is None:
            self.breaks = [m.start() for m in re.finditer("\n", self.source)]
        return bisect_left(self.breaks, self.p[min(self.i, len(self.p) - 1)]) + 1

    def record(self, cause: object) -> None:
        self.issues.append(SyntaxIssue(self.line(), str(cause)))

    def guarded(self, statement, stop: tuple[str, ...] = ()) -> None:
        """Runs a statement; after an error, skips to where another may start."""
        start = self.i
        try:
            statement()
        except Panic as e:
            self.record(e)
            if self.i == start and not self.at("eof"):
                self.skip()
            self.recover(stop)

    def recover(self, stop: tuple[str, ...]) -> None:
        """Panic mode: over balanced brackets to a terminator, a closing bracket of the block or a starting keyword."""
        while not self.at("eof"):
            kind = self.k[self.i]
            if kind == ";" or kind == "nl":
                self.skip()
                return
            if kind in stop or kind in self.RESUME:
                return
            if kind in self.OPENERS:
                self.balanced()
            else:
                self.skip()

    def balanced(self) -> None:
        """Skips a bracketed stretch, as far as it goes."""
        depth = 0
        while not self.at("eof"):
            kind = self.skip()
            if kind in self.OPENERS:
                depth += 1
            elif kind in ")]}":
                depth -= 1
                if depth <= 0:
                    return

    def group(self, close: str, item, trailing: bool = True) -> None:
        """Items between an opener already taken and ``close``, by commas."""
        while not self.accept(close):
            item()
            if self.accept(","):
                if not trailing and self.at(close):
                    self.fail("item expected after ,")
            elif not self.at(close):
                self.fail(f"expected {close}")

    def climb(self, least: int, operand, binary: dict[str, int], right: frozenset[str] = frozenset(), rest=None) -> None:
        """Precedence climbing: operands joined by operators that bind at least as tightly as ``least``."""
        operand()
        while True:
            kind = self.k[self.i]
            level = binary.get(kind)
            if level is None or level < least:
                return
            if rest is not None and rest(kind, level):
                continue
            self.i += 1
            self.climb(level if kind in right else level + 1, operand, binary, right, rest)
