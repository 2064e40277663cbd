"""Cutting texts for vocabularies of the byte-level kind, and a bounded table of piece ids.

A token never holds a visible sign before a white-space sign, so a text may be cut before any
space that follows a visible sign: the pieces are encoded independently, with the same ids as
the whole text. Most pieces are single words that come again and again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space that a text may not be cut at; more kinds of white space than a vocabulary has are safe.
UNSAFE = re.compile(r"\s ")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Pieces:
    """Ids of texts by way of their pieces. ``encode_many`` encodes texts independently.

    ``most`` bounds the table and ``longest`` the length of a piece in it; both only decide how
    often a piece is encoded.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = 600_000, longest: int = 48):
        self.encode_many, self.most, self.longest = encode_many, most, longest
        self.ids: dict[str, bytes] = {}

    def encode_all(self, texts: list[str], chars: int = 4_000_000):
        """Yield the ids of each text; about ``chars`` code points are worked on at a time."""
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= chars:
                yield from self._encode(part)
                part, size = [], 0
        yield from self._encode(part)

    def encode(self, text: str) -> bytes:
        return self._encode([text])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        known = self.ids
        if len(known) > self.most:
            known.clear()
        new = list(set().union(*(rest for _, rest in cut)) - known.keys())
        found = self.encode_many([first for first, _ in cut] + [" " + x for x in new])
        known.update(zip(new, found[len(cut):]))
        out = [ids + b"".join(map(known.__getitem__, rest)) for ids, (_, rest) in zip(found, cut)]
        for x in new:
            if len(x) > self.longest:
                del known[x]
        return out

    def _cut(self, text: str) -> tuple[str, list[str]]:
        if text[:1].isspace() or UNSAFE.search(text):
            return self._joined(text.split(" "))
        first, *rest = text.split(" ")
        return first, rest

    @staticmethod
    def _joined(parts: list[str]) -> tuple[str, list[str]]:
        """Take back the cuts at spaces that don't follow a visible sign."""
        out: list[list[str]] = []
        last = ""
        for i, p in enumerate(parts):
            if out and (not last or last.isspace()):
                out[-1].append(p)
            else:
                out.append([p])
            # the sign before the next space; an empty part leaves the space before it
            last = p[-1] if p else " "
        joined = [" ".join(x) for x in out]
        return joined[0], joined[1:]
