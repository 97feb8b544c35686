"""Cutting texts where byte-level tokenizers cut them, and keeping what was made of each piece."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Letters, numbers and white space among the first 256 code points.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def narrow(pattern: str) -> re.Pattern:
    """The pattern as it acts on texts of the first 256 code points, spelled out for the faster library."""
    inside = {r"\p{L}": LETTERS, r"\p{N}": NUMBERS, r"\s": SPACES}
    out, in_class, k = [], False, 0
    while k < len(pattern):
        token = next((t for t in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(t, k)), pattern[k])
        if token in inside:
            out.append(inside[token] if in_class else f"[{inside[token]}]")
        elif token == r"\S":
            if in_class:
                raise ValueError("a negated class inside a class")
            out.append(f"[^{SPACES}]")
        else:
            in_class = token == "[" or in_class and token != "]"
            out.append(token)
        k += len(token)
    return re.compile("".join(out))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text."""
    import regex

    wide, fast = regex.compile(pattern).findall, narrow(pattern).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return fast(text)

    return split


class Recent:
    """Piece -> value in two generations of at most ``most`` each; what is asked for again stays."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def all(self, pieces: list[str], make: Callable[[list[str]], list]) -> list:
        """The values of pieces; ``make`` gives those of the different ones that aren't kept."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        new = self.new
        got = list(map(new.get, pieces))
        if None in got:
            missing = {p for p, x in zip(pieces, got, strict=True) if x is None}
            again = {p: x for p in missing if (x := self.old.get(p)) is not None}
            todo = [p for p in missing if p not in again]
            more = again | dict(zip(todo, make(todo), strict=True))
            got = [more[p] if x is None else x for p, x in zip(pieces, got, strict=True)]
            new.update((p, x) for p, x in more.items() if len(p) < 60)
        return got
