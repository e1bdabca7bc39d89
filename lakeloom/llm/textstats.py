"""Statistics of texts in one pass over the signs of a whole batch: classes of signs are counted for all texts at once."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Signs of one batch that are held as numbers at a time; a longer text is a batch of its own.
BATCH_SIGNS = 2_000_000
SPACE, SYMBOL, DIGIT, UPPER, CJK, BROKEN, ODD = (1 << k for k in range(7))

_ASCII_SPACE = "\t\n\x0b\x0c\r "
_SEPARATORS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "Z")
_FORMATS = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cf")
_S = f"[{re.escape(_ASCII_SPACE + _SEPARATORS)}]"
LINES = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
SPLIT = re.compile(f"{_S}+")
VISIBLE = re.compile(f"[^{re.escape(_ASCII_SPACE + _SEPARATORS + _FORMATS)}]")
#: A list item's mark, the end of a sentence, and cells kept apart by blanks.
BULLET = re.compile(r"[ \t\n\x0b\f\r]*(?:[-–—*•‣▪◦·+]|\[[ xX✓]?\]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])[ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]")
END = re.compile(r"[.!?…:;。！？؟।][\"'”’»)\]]*[ \t\n\x0b\f\r]*\Z")
GAPS = re.compile(r"[^ \t\n\x0b\f\r] {2,}(?=[^ \t\n\x0b\f\r])")
FULL_STOPS = re.compile("[。！？]")
SENTENCES = re.compile(rf"[.!?…][\"'”’»)\]]*(?={_S}|\Z)|[。！？।]")
BROKEN_PAIRS = re.compile("â€|ï¿½")
LETTERS, PLAIN_LETTERS = regex.compile(r"[\p{L}\p{M}]+"), re.compile(r"[^\W\d_]+")
CONSONANTS = re.compile("[b-df-hj-np-tv-z]{2,}")
_ASCII_SPLIT = re.compile(r"[ \t\n\x0b\f\r]+")
#: Cell separators with the least number of them in a line of a table.
SEPARATORS = (("\t", 1), ("|", 1), (";", 2), (",", 2), (GAPS, 1))


def _class(c: str) -> int:
    kind = unicodedata.category(c)
    out = SPACE if kind[0] == "Z" or c in _ASCII_SPACE else SYMBOL if kind[0] not in "LMN" else DIGIT if kind[0] == "N" else 0
    if kind == "Lu":
        out |= UPPER
    if kind[0] == "M" or kind in ("Nl", "No"):
        out |= ODD
    if c in "ÃÂÐ�" or c < "\x09" or "\x0e" <= c <= "\x1f":
        out |= BROKEN
    return out | (CJK if _CJK.match(c) else 0)


_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.array([_class(chr(n)) if not 0xD800 <= n <= 0xDFFF else SYMBOL for n in range(0x10000)], dtype=np.uint8)


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _table()[np.minimum(codes, 0xFFFF)]
    for n in np.flatnonzero(codes > 0xFFFF).tolist():
        out[n] = _class(text[n])
    return out


def sign_counts(texts: list[str]) -> dict[int, np.ndarray]:
    """How many signs of each class every text has."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in (SPACE, SYMBOL, DIGIT, UPPER, CJK, BROKEN, ODD)}
    some = np.flatnonzero(sizes)
    at = 0
    while at < len(some):
        size, stop = 0, at
        while stop < len(some) and (stop == at or size + sizes[some[stop]] <= BATCH_SIGNS):
            size += sizes[some[stop]]
            stop += 1
        part = some[at:stop]
        classes = _classes("".join(texts[n] for n in part.tolist()))
        starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
        for k, counts in out.items():
            counts[part] = np.add.reduceat((classes & k) != 0, starts, dtype=np.int64)
        at = stop
    return out


class _Words(dict):
    """word -> (1 if common) + (2 if it has no vowel); filled as words come, emptied when it grows large."""

    def __init__(self, common: frozenset):
        self.common = common

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        v = self[w] = (w in self.common) + 2 * bool(CONSONANTS.fullmatch(w))
        return v


def seen_words(common: frozenset) -> _Words:
    return _Words(common)


def _median(values: list[int]) -> int:
    return sorted(values)[len(values) // 2] if values else 0


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics(texts: list[str], common: frozenset, words_seen: _Words | None = None) -> list[tuple]:
    """One tuple a text, in the order of ``quality.NAMES``, and whether it has a sign that is no white space."""
    signs, seen, out = sign_counts(texts), words_seen if words_seen is not None else _Words(common), []
    for n, t in enumerate(texts):
        spaces, symbols, digits, upper, cjk, broken, odd = (int(signs[k][n]) for k in signs)
        shown = len(t) - spaces
        if "ï¿½" in t or "â€" in t:
            # a pair counts once, whatever its signs count for
            broken += len(BROKEN_PAIRS.findall(t))
        words = (LETTERS if odd else PLAIN_LETTERS).findall(t.lower())
        flags = [seen[w] for w in words]
        n_words = len(words)
        lines = [s for s in LINES.split(t) if VISIBLE.search(s)]
        n_lines = len(lines)
        tokens = t.split() if t.isascii() and "\x1c" not in t and "\x1d" not in t and "\x1e" not in t and "\x1f" not in t else [w for w in SPLIT.split(t) if w]
        per_line = [len(SPLIT.split(s.strip(" "))) for s in lines]
        ended = sum(1 for s in lines if END.search(s))
        bullets = sum(1 for s in lines if BULLET.match(s) and not FULL_STOPS.search(s) and len(_ASCII_SPLIT.split(s.strip(" "))) <= 14)
        grid = 0.0
        if n_lines >= 3:
            for sep, least in SEPARATORS:
                if isinstance(sep, str):
                    if sep not in t:
                        continue
                    counts = [s.count(sep) for s in lines]
                else:
                    if "  " not in t:
                        continue
                    counts = [len(sep.findall(s)) for s in lines]
                mid = _median(counts)
                if mid >= least:
                    grid = max(grid, counts.count(mid) / n_lines)
        sentences = len(SENTENCES.findall(t))
        out.append((
            float(n_lines), float(n_words), _ratio(shown, len(tokens)), float(max(map(len, tokens), default=0)), _ratio(symbols, shown), _ratio(digits, shown), _ratio(shown - symbols - digits, shown), _ratio(upper, shown), _ratio(cjk, shown), _ratio(broken, shown),
            _ratio(ended, n_lines), _ratio(sum(f & 1 for f in flags), n_words), _ratio(bullets, n_lines), grid, float(_median(per_line)), _ratio(sentences, n_words + cjk / 3), _ratio(len(set(words)), n_words), _ratio(sum(f >> 1 for f in flags), n_words),
            _ratio(n_lines - len(set(lines)), n_lines), _ratio(sentences, n_lines), shown > 0,
        ))
    return out
