"""Byte-pair encoding of a whole corpus with a public vocabulary, by prefix dynamic programming.

For every prefix of a byte string exactly one token can come last in its encoding. ``last[i]`` is the longest token that
ends at i and whose neighbour ``last[i - len]`` may stand before it; a pair may stand together if encoding their joined
bytes gives the pair back. The table of last tokens is the encoding of all prefixes at once: bytes can be appended
without looking back, and after an edit only prefixes from the edit on are computed again.
"""

from __future__ import annotations

import json
import os

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ship

#: Where the public vocabularies lie; a parameter of every entry point.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that this vocabulary's texts are cut with before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_signs() -> dict[str, int]:
    """The printable sign that the vocabulary file writes for each byte: itself if printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the test whether two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        signs = _byte_signs()
        ids = {s: i for s, i in model["vocab"].items() if all(c in signs for c in s)}
        self.rank: dict[int, int] = {}  # place of the merge that makes a token; bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}  # pair -> place of its merge
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = ids[a + b]
            self.merge[ids[a], ids[b]] = n
            if t not in self.rank:
                self.rank[t], self.parts[t] = n, (ids[a], ids[b])
        tokens = {i: bytes(signs[c] for c in s) for s, i in ids.items()}
        # a token whose own bytes encode otherwise can never come out
        self.of = {raw: i for i, raw in tokens.items() if i not in self.rank or self._apart(*self.parts[i], self.rank[i])}
        self.sizes = {i: len(raw) for raw, i in self.of.items()}
        self.longest = max(self.sizes.values(), default=0)
        self._known: dict[tuple[int, int], bool] = {}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of the joined bytes of ``a`` and ``b`` is [a, b]."""
        got = self._known.get((a, b))
        if got is None:
            got = self._known[a, b] = self._apart(a, b, 1 << 60)
        return got

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` happens before merge ``until``.

        Merges happen in the order of their places, of equal ones the left first. The pieces that meet at the border are
        undone, the latest first; so every pair that ever meets there is seen, with the merges that take its sides away.
        """
        end_a = end_b = until
        while True:
            n = self.merge.get((a, b))
            if n is not None and n < end_a and n <= end_b:
                return False
            made_a, made_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                end_a, a = made_a, self.parts[a][1]
            else:
                end_b, b = made_b, self.parts[b][0]


class Prefixes:
    """The last token of every byte prefix of one piece of text."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Appends bytes; earlier entries stay as they are."""
        v, start = self.v, len(self.data)
        self.data += more
        data, last, of = self.data, self.last, v.of
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - v.longest), end):
                t = of.get(data[begin:end])
                if t is not None and (begin == 0 or v.neighbours(last[begin - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("a byte has no token")

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Replaces bytes; entries before ``begin`` are kept, later ones computed again."""
        tail = self.data[end:]
        self.data, self.last = self.data[:begin], self.last[:begin]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        sizes = self.v.sizes
        while at:
            t = self.last[at - 1]
            out.append(t)
            at -= sizes[t]
        return out[::-1]


class Encoder:
    """Encodes texts; pieces repeat, so their ids are kept, up to ``keep`` pieces (then forgotten, never wrong)."""

    def __init__(self, path: str, keep: int = 200_000):
        self.v, self.keep, self.known = Vocabulary(path), keep, {}
        self.cut = regex.compile(PATTERN)

    def piece(self, text: str) -> list[int]:
        got = self.known.get(text)
        if got is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            got = self.known[text] = Prefixes(self.v, text.encode("utf-8", "surrogatepass")).ids()
        return got

    def encode(self, text: str | None) -> list[int]:
        """The ids; an empty list for null and empty texts. Names of special tokens are ordinary text."""
        out: list[int] = []
        for m in self.cut.findall(text or ""):
            out += self.piece(m)
        return out


class TextPrefixes:
    """An encoded text that can be appended to and edited; only pieces from the change on are cut and encoded again."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e, self.text, self.pieces = encoder, "", []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> None:
        """A change can move the border of the piece before it, and white space looks one sign ahead: two pieces are redone."""
        old = self.pieces
        keep = next((n for n, (at, s, _) in enumerate(old) if at + len(s) >= begin), len(old))
        keep = max(0, keep - 1)
        at = old[keep][0] if keep < len(old) else len(self.text)
        shift = len(new) - (end - begin)
        later = {p[0] + shift: n for n, p in enumerate(old) if p[0] > end}
        self.text = self.text[:begin] + new + self.text[end:]
        out = old[:keep]
        for m in self.e.cut.finditer(self.text, at):
            n = later.get(m.start())
            if n is not None and m.group() == old[n][1] and m.start() > begin + len(new):
                out += [(a + shift, s, i) for a, s, i in old[n:]]  # in step again: the rest is as before
                break
            out.append((m.start(), m.group(), self.e.piece(m.group())))
        self.pieces = out

    def ids(self) -> list[int]:
        return [i for _, _, ids in self.pieces for i in ids]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = FOLDER) -> Encoder:
    """One encoder per worker process and vocabulary."""
    path = os.path.join(folder, f"{name}.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """The token ids of ``text`` as array<int>; an empty array for null and empty texts."""

    ship()

    @pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        e = encoder(name, folder)
        return texts.map(e.encode, na_action=None)

    return F.when(text.isNull() | (text == ""), F.array().cast("array<int>")).otherwise(run(text))
