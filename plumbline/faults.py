"""Why a text is no value: reason, detail and span; and the trimming that all doors share."""

from __future__ import annotations

from functools import wraps

from .codes import WHITE_SPACE

DIGITS = "0123456789"


class Fault(Exception):
    def __init__(self, reason: str, detail: str, offset: int = 0, length: int = 0):
        super().__init__(reason, detail, offset, length)
        self.reason, self.detail, self.offset, self.length = reason, detail, offset, length


def bad(detail: str, a: int, b: int) -> Fault:
    return Fault("malformed", detail, a, b - a)


def beyond(detail: str, a: int, b: int) -> Fault:
    return Fault("out_of_range", detail, a, b - a)


def edges(s: str, a: int = 0, b: int | None = None) -> tuple[int, int]:
    b = len(s) if b is None else b
    while a < b and s[a] in WHITE_SPACE:
        a += 1
    while b > a and s[b - 1] in WHITE_SPACE:
        b -= 1
    return a, b


def token(s: str) -> tuple[int, int]:
    a, b = edges(s)
    if a == b:
        raise Fault("empty", "blank")
    return a, b


def near(t: str, i: int, detail: str, n: int = 1) -> Fault:
    """At n characters from i, as far as there are any; an empty span at the end where the text ends first."""
    return bad(detail, min(i, len(t)), min(i + n, len(t)))


def at_last(t: str, i: int, detail: str) -> Fault:
    """At the character at i, or the last one where the text ends first."""
    i = min(i, len(t) - 1)
    return bad(detail, i, i + 1)


def _in_characters(t: str, a: int, b: int) -> tuple[int, int]:
    """A span in bytes of t's UTF-8, widened to whole characters."""
    starts, at = [], 0
    for c in t:
        starts.append(at)
        at += len(c.encode("utf-8", "surrogateescape"))
    from bisect import bisect_right

    lo = len(t) if a >= at else bisect_right(starts, a) - 1
    return lo, max(lo, bisect_right(starts, b - 1)) if b > a else lo


def door(by_bytes: bool = False):
    """A reader of trimmed text, with spans from its start, to a cast of whole texts.

    by_bytes: the reader's widths are of UTF-8; it sees a text with other than ASCII as one character a byte.
    """

    def made(read):
        @wraps(read)
        def cast(s: str, *how, **more):
            a, b = token(s)
            t = s[a:b]
            try:
                if not by_bytes or t.isascii():
                    return read(t, *how, **more)
                try:
                    return read(t.encode("utf-8", "surrogateescape").decode("latin-1"), *how, **more)
                except Fault as e:
                    raise Fault(e.reason, e.detail, *(lambda x: (x[0], x[1] - x[0]))(_in_characters(t, e.offset, e.offset + e.length))) from None
            except Fault as e:
                if not a:
                    raise
                raise Fault(e.reason, e.detail, e.offset + a, e.length) from None

        return cast

    return made
