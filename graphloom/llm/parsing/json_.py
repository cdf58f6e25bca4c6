"""Strict JSON."""

from __future__ import annotations

import re

from graphloom.llm.parsing.base import Parser, SyntaxIssue, scan

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\n\r]+)
    |(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")
    |(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))
    |(?P<id>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<op>[{}\[\]:,])""",
    re.X,
)
_WORDS = frozenset(["true", "false", "null"])


_SCALARS = frozenset(["str", "num", "true", "false", "null"])
_CLOSE = {"{": "}", "[": "]"}


class Json(Parser):
    """A stack of open brackets instead of recursion, so that texts may nest to any depth.

    After an error the rest of the line is passed over, up to a comma or
    bracket; each character that starts no token is an error of its own.
    """

    def error(self, cause: str) -> None:
        self.record(cause + (" before the end" if self.at("eof") else ""))

    def resync(self) -> None:
        while self.skip() != "eof":
            if self.g[self.i] or self.k[self.i] in ("bad", ",", "{", "[", "}", "]", "eof"):
                return

    def document(self) -> None:
        held: list[str] = []
        state = "value"  # or close (a first item or the end), key, colon, after
        while True:
            kind = self.k[self.i]
            if kind == "bad":
                self.error("unknown character")
                self.skip()
            elif kind == "eof":
                if held:
                    self.error(f"expected {_CLOSE[held[-1]]}")
                elif state != "after":
                    self.error("value expected")
                return
            elif kind in ("}", "]") and state != "colon":
                if not held or _CLOSE[held[-1]] != kind:
                    self.error(f"expected {_CLOSE[held[-1]]}" if held else "one value only" if state == "after" else "value expected")
                elif state not in ("after", "close"):
                    self.error("item expected after ,")
                if held and (_CLOSE[held[-1]] == kind or any(_CLOSE[x] == kind for x in held)):
                    while _CLOSE[held.pop()] != kind:
                        pass
                    state = "after"
                self.skip()
            elif state == "after":
                if held and kind == ",":
                    self.skip()
                    state = "key" if held[-1] == "{" else "value"
                    continue
                self.error(f"expected {_CLOSE[held[-1]]}" if held else "one value only")
                if held and (kind in _SCALARS or kind in _CLOSE):
                    state = "key" if held[-1] == "{" else "value"
                elif kind in _CLOSE:
                    state = "value"
                else:
                    self.resync()
            elif state == "key" or (state == "close" and held[-1] == "{"):
                if kind == "str":
                    self.skip()
                    state = "colon"
                    continue
                self.error("expected str")
                if kind in _CLOSE:
                    state = "value"
                else:
                    self.resync()
                    state = "after"
            elif state == "colon":
                if kind == ":":
                    self.skip()
                else:
                    self.error("expected :")
                state = "after" if kind in (",", "}", "]") else "value"
            elif kind in _SCALARS:
                self.skip()
                state = "after"
            elif kind in _CLOSE:
                self.skip()
                held.append(kind)
                state = "close"
            else:
                self.error("value expected")
                if kind == ",":
                    state = "after" if held else "value"
                    if not held:
                        self.skip()
                else:
                    self.resync()
                    state = "after"


def check(source: str) -> list[SyntaxIssue]:
    p = Json(source, scan(source, _TOKEN, _WORDS))
    p.document()
    return p.issues
