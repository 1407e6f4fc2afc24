"""Splitting text where the byte-level pattern splits anyway, so that repeated pieces are encoded once per task.

The public pattern (``public_tokenizers.PATTERN``) always starts a new match at a single space between two characters
that are no white space: nothing before it can take the space in, and the space is taken by the match that follows.  So
a text cut at such spaces can be encoded piece by piece.  Python's idea of white space contains the pattern's, hence
cutting only where Python sees none on either side is on the safe side.
"""

from __future__ import annotations

import re
from collections.abc import Callable

SAFE = re.compile(r"(?<=\S) (?=\S)")


ENDINGS = ",.;:!?"  # after letters, one of these is a match of its own


def whole(part: str) -> bool:
    return part != "" and part == part.strip()


class Unsafe(Exception):
    pass


class PieceCodes(dict):
    """Codes of text pieces by ``encode`` (list of pieces to list of bytes); about ``limit`` pieces are remembered.

    As a dict it numbers pieces without their leading space; ``codes`` holds the code of each number.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 500_000):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.codes: list[bytes | None] = []
        self.fresh: list[str] = []  # pieces with their space, not yet encoded, and their numbers
        self.numbers: list[int] = []
        self.joined: list[tuple[int, int, str]] = []

    def __missing__(self, part: str) -> int:
        if not whole(part):
            raise Unsafe
        return self.add(part)

    def add(self, part: str) -> int:
        if part[-1] in ENDINGS and part[:-1].isalpha():
            base = self[part[:-1]]
            number = self[part] = len(self.codes)
            self.joined.append((number, base, part[-1]))
        else:
            number = self[part] = len(self.codes)
            self.fresh.append(" " + part)
            self.numbers.append(number)
        self.codes.append(None)
        return number

    def odd(self, part: str) -> int:
        """Number of a piece with white space at an end; its key has the space, as no safe piece's key has."""
        number = self.get(" " + part)
        if number is None:
            number = self[" " + part] = len(self.codes)
            self.fresh.append(" " + part)
            self.numbers.append(number)
            self.codes.append(None)
        return number

    def index(self, texts: list[str]) -> tuple[list[str], list[list[int]]]:
        """Each text's first piece and the numbers of its others; pieces seen for the first time wait in ``fresh``."""
        firsts, rows = [], []
        for text in texts:
            parts = text.split(" ")
            try:
                if parts[0] == "" or parts[0][-1].isspace():
                    raise Unsafe
                row = list(map(self.__getitem__, parts[1:]))
            except Unsafe:
                parts = SAFE.split(text)
                row = [self[p] if whole(p) else self.odd(p) for p in parts[1:]]
            firsts.append(parts[0])
            rows.append(row)
        return firsts, rows

    def resolve(self, firsts: list[str]) -> list[bytes]:
        """Codes of the first pieces; pieces that waited get theirs as well."""
        ends = list(ENDINGS)
        found = self.encode(firsts + self.fresh + ends)
        for number, code in zip(self.numbers, found[len(firsts):]):
            self.codes[number] = code
        endings = dict(zip(ends, found[len(firsts) + len(self.fresh):]))
        for number, base, ending in self.joined:
            self.codes[number] = self.codes[base] + endings[ending]
        self.fresh, self.numbers, self.joined = [], [], []
        return found[:len(firsts)]

    def of(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the codes of its pieces, in order."""
        if len(self) > self.limit:
            self.clear()
            self.codes.clear()
        firsts, rows = self.index(texts)
        code_of = self.codes.__getitem__
        return [[first, *map(code_of, row)] for first, row in zip(self.resolve(firsts), rows)]
