"""Personal information in free text: spans are proposed by expressions, confirmed by checksums and weighed by context."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread
from .names import names

KINDS = ("email", "phone", "id_number", "address", "name")
#: A span below this score is no finding.
THRESHOLD = 0.5
#: Signs on each side in which context words are looked for.
NEAR = 28


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    """Check digit of payment cards."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check digits of international account numbers."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


_W = r"[^\W_]"  # a letter or digit
_L = r"[^\W\d_]"  # a letter
_EDGE, _TAIL = r"(?<![\w@.+-])", r"(?![\w@])"

# no repetition can match what follows it, so each is possessive and of any length
EMAILS = [
    re.compile(rf"(?<![\w.+@-]){_W}[\w.+%-]*+@{_W}[\w-]*+(?:\.{_W}[\w-]*+)++(?![\w@])"),
    re.compile(rf"(?<![\w.+@-]){_W}[\w.+%-]*+ ?[\[({{<] ?at ?[\])}}>] ?{_W}[\w-]*+(?:(?:\.| ?[\[({{<] ?dot ?[\])}}>] ?){_W}[\w-]*+)++(?![\w@])", re.I),
    re.compile(rf"(?<![\w.+@-]){_W}[\w.+%-]*+ at {_W}[\w-]*+(?: dot {_W}[\w-]*+)++(?![\w@])", re.I),
]

#: Score of what has the shape of a payment card or international account; it counts only with the right check digits.
CARD = 0.3
#: Usual groupings of payment cards, as lengths of the groups.
CARD_GROUPS = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 4, 4, 1), (4, 4, 4, 2), (4, 4, 4, 3), (4, 3, 3, 3), (6, 7), (6, 13), (4, 5, 6), (4, 4, 5)})

#: First digits of payment cards by length; an ungrouped row of digits with others, or longer than 16 as positions are, needs a context word.
CARD_STARTS = {13: ("4",), 14: ("30", "36", "38", "39"), 15: ("34", "37", "1800", "2131")}

# (pattern, score without context); the number itself is group 1
IDS = [
    (re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"), 0.6),
    (re.compile(r"(?<![\w.+-])(?<!\d )(\d{3} \d{2} \d{4})(?! ?\d)(?!\w)"), 0.45),
    (re.compile(r"(?<![\w.+-])(?<!\d )(\d{2} \d{3} \d{3} \d{3})(?! ?\d)(?!\w)"), 0.5),
    (re.compile(r"(?<![\w-])([A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?!\w)"), 0.6),
    (re.compile(r"(?<![\w-])([A-Z]{1,2}\d{7})(?![\w-])"), 0.5),
    (re.compile(r"(?<![\w-])([A-Z]{2}-\d{6}-\d)(?![\w-])"), 0.6),
    (re.compile(r"(?<![\w.+-])(?<!\d )(\d{13,19}|\d{2,6}(?:[ -]\d{1,13}){1,4})(?![ -]?\d)(?!\w)"), CARD),
    (re.compile(r"(?<![\w-])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"), 0.3),
    (re.compile(r"(?:tax id|steuer-id|steuernummer|passport(?: no\.?)?|id card|national id|ssn|social security no\.?|social|insurance no\.?|ni number)[:#]? {0,2}([A-Z]{0,3}[ -]?\d[\d /-]{3,18}\d(?:-?[A-Z0-9])?)(?!\w)", re.I), 0.5),
]
ID_WORDS = re.compile(r"\b(?:card|passport|ssn|social|security|tax|steuer|insurance|national|identity|ausweis|licence|iban|account|ni number|id)\b", re.I)

# (pattern, score without context)
PHONES = [
    (re.compile(r"(?<![\w+.-])\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?(?:\(\d{1,5}\)|\d{1,5})){1,6}(?![\w-])(?!\.\d)"), 0.8),
    (re.compile(r"(?<![\w+.-])00\d{2}(?: ?\(0\))? ?\d{2,5}(?:[ .-]?\d{2,6}){1,4}(?![\w-])"), 0.7),
    (re.compile(r"(?<![\w+.-])\(\d{2,5}\) ?\d{3,4}[ .-]\d{3,5}(?![\w-])"), 0.7),
    (re.compile(r"(?<![\w+.-])\d{3}\.\d{3}\.\d{4}(?![\w.-])(?!\.\d)"), 0.7),
    (re.compile(r"(?<![\w+.-])\d{3}-\d{3}-\d{4}(?![\w-])"), 0.7),
    (re.compile(r"(?<![\w+.-])(?<![\d)] )[2-9]\d{2}-\d{4}(?![\w-])"), 0.6),
    (re.compile(r"(?<![\w+.-])(?<!\d )0\d{2,4} \d{3}[ -]?\d{3,4}(?:[ -]?\d{2,4})?(?! ?\d)(?![\w-])"), 0.6),
    (re.compile(r"(?<![\w+.-])(?<!\d )0\d(?: \d\d){4}(?! ?\d)(?![\w-])"), 0.6),
    (re.compile(r"(?<![\w+.-])(?<!\d )1[2-9]\d{2}[2-9]\d{6}(?![\w-])"), 0.58),
    (re.compile(r"(?<![\w+.-])(?<!\d )\d{7,15}(?![\w-])"), 0.2),
]
PHONE_WORDS = re.compile(r"\b(?:call|phone|tel|telefon|number is|mobile|text me|reach me|fax|on call|pager)\b", re.I)
NUMBER_WORDS = re.compile(r"\b(?:position|build|order|watermark|delta|hash|version|count|rows|says|says it|job|ticket|files|pk)\b", re.I)

#: Kinds of streets; those that are everyday words too are told apart.
_KIND = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|boulevard|blvd\.?|court|ct\.?|terrace|drive|square|crescent|hill|gardens|parade|grove|mews|parkway|pkwy\.?|highway|hwy\.?|alley|quay|wharf|circle|close|walk)"
_WEAK_KIND = r"(?:way|place|row|rise|view|green|path|trail|park|bend|point)"
#: Words that never stand between a house number and the kind of its street.
_NO_STREET = r"(?!(?:in|a|an|the|of|per|at|on|to|is|are|was|were|and|or|for|from|by|with|rows?|files?|records?|buckets?|workers?|times?|days?|hours?|minutes?|more|new|out|into|over|under|it|this|that|we|i)\b)"
_WORD = rf"{_NO_STREET}{_L}[\w'’.-]*"
_PLACED = r"(?:(?<=\bat )|(?<=\bto )|(?<=\bis )|(?<=\bin )|(?<=address )|(?<=address: )|(?<=, )|(?<=; )|(?<=;)|(?<=\n)|(?<=^))"
ADDRESSES = [
    re.compile(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?,? (?:{_WORD} ){{1,3}}?{_KIND}(?!\w)(?:,? (?:apt|flat|unit|suite)\.? ?\w{{1,5}})?", re.I),
    re.compile(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?,? (?:{_NO_STREET}(?-i:[A-Z]){_L}[\w'’.-]* ){{1,3}}?{_WEAK_KIND}(?!\w)(?:,? (?:apt|flat|unit|suite)\.? ?\w{{1,5}})?", re.I),
    re.compile(rf"{_PLACED}\d{{1,5}}[A-Za-z]?,? (?:{_WORD} ){{1,3}}?{_WEAK_KIND}(?!\w)(?:,? (?:apt|flat|unit|suite)\.? ?\w{{1,5}})?", re.I),
    re.compile(r"(?<![\w.-])\d{1,5}(?: ?(?:bis|ter|[A-Da-d]))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route) (?:de la |de l['’]|des |du |de |d['’])?" + rf"{_WORD}(?: [A-ZÀ-Þ]{_L}+)?", re.I),
    re.compile(rf"(?<![\w-]){_L}[\w-]{{2,40}}(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer)(?: ?{_W}{{0,0}}) ?\d{{1,4}} ?[a-z]?(?!\w)", re.I),
    re.compile(rf"(?<![\w-])(?:calle|avenida|plaza|paseo|camino|carrera|via|ulica|ul\.) (?:del |de la |de los |de las |de |la |el )?(?:{_WORD} ){{1,3}}?\d{{1,4}}[A-Za-z]?(?!\w)", re.I),
]

def _words_near(text: str, start: int, end: int, words: re.Pattern) -> bool:
    return bool(words.search(text[max(0, start - NEAR) : start]) or words.search(text[end : end + NEAR // 2]))


def _ids(text: str, phone: bool) -> Iterator[Span]:
    for pattern, base in IDS:
        for m in pattern.finditer(text):
            start, end = m.span(1)
            bare = re.sub(r"[ -]", "", m.group(1))
            score = base + 0.3 * bool(ID_WORDS.search(text[max(0, start - NEAR) : start]))
            if base == CARD and bare.isdigit():
                groups = tuple(map(len, re.split(r"[ -]", m.group(1))))
                if not 13 <= len(bare) <= 19 or not luhn(bare) or (len(groups) > 1 and groups not in CARD_GROUPS):
                    continue
                sure = len(bare) == 16 or len(groups) > 1 or (bare.startswith(CARD_STARTS.get(len(bare), ())) and not phone and not NUMBER_WORDS.search(text[max(0, start - 14) : start]))
                score += 0.4 * sure
            elif len(bare) >= 15 and bare[:2].isalpha() and bare[2:4].isdigit():
                if not mod97(bare.upper()):
                    continue
                score += 0.5
            if sum(c.isdigit() for c in bare) >= 5:
                yield Span(start, end, "id_number", score)


def _phones(text: str, phone: bool) -> Iterator[Span]:
    for pattern, base in PHONES:
        for m in pattern.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if 7 <= digits <= 15:
                score = base + 0.3 * (phone or _words_near(text, *m.span(), PHONE_WORDS))
                if base < 0.6:  # a bare row of digits is often a count or a position
                    score -= 0.3 * bool(NUMBER_WORDS.search(text[max(0, m.start() - 14) : m.start()]))
                yield Span(m.start(), m.end(), "phone", score)


def _names(text: str, phone: bool) -> Iterator[Span]:
    for start, end, score in names(text):
        yield Span(start, end, "name", score)


_AT = re.compile(r"\bat\b", re.I)


def _emails(text: str, phone: bool) -> Iterator[Span]:
    spelled = bool(_AT.search(text))
    for n, pattern in enumerate(EMAILS):
        if "@" in text if n == 0 else spelled:
            for m in pattern.finditer(text):
                yield Span(*m.span(), "email", 1.0)


def _addresses(text: str, phone: bool) -> Iterator[Span]:
    for pattern in ADDRESSES:
        for m in pattern.finditer(text):
            yield Span(*m.span(), "address", 0.8)


_DIGIT = re.compile(r"\d")
#: Kinds from the surest to the least sure: (mark, search, least number of digits in the text).
SEARCHES = (("\x01", _emails, 0), ("\x03", _ids, 5), ("\x04", _addresses, 1), ("\x02", _phones, 7), ("\x05", _names, 0))


#: Chats repeat short texts; findings of texts up to this length are kept by each worker.
SHORT = 200


def _search(text: str, phone: bool = False) -> tuple[Span, ...]:
    found: list[Span] = []
    work, digits = text, len(_DIGIT.findall(text))
    for mark, search, least in SEARCHES:
        if digits < least:
            continue
        taken: list[tuple[int, Span]] = []  # by start, without overlaps
        for s in sorted(search(work, phone), key=lambda s: (-s.score, s.start - s.end)):
            at = bisect(taken, (s.start,))
            clear = (at == len(taken) or s.end <= taken[at][0]) and (at == 0 or taken[at - 1][1].end <= s.start)
            if s.score >= THRESHOLD and clear:
                taken.insert(at, (s.start, s))
        out, end = [], 0
        for _, s in taken:
            out += [work[end : s.start], mark * (s.end - s.start)]
            end = s.end
        work = "".join(out) + work[end:]
        found += [s for _, s in taken]
    return tuple(sorted(found, key=lambda s: s.start))


_found = lru_cache(maxsize=50_000)(_search)


#: Fields that hold telephone numbers: there a bare row of digits has its context.
PHONE_FIELDS = frozenset({"sender_ph"})


def find(text: str | None, field: str | None = None) -> list[Span]:
    """All findings of one text, in order, without overlaps. Null and empty texts have none.

    Kinds are searched from the surest to the least sure; what a kind takes is marked, so a name in an email address or a
    telephone number in a card number is not found again. Within a kind the better score, then the longer span wins.
    The name of the field is context: one of ``PHONE_FIELDS`` counts as a telephone word.
    """
    if not text:
        return []
    phone = field in PHONE_FIELDS
    return list(_found(text, phone) if len(text) <= SHORT else _search(text, phone))


def redact(text: str | None, field: str | None = None) -> str | None:
    """The text with each finding replaced by a placeholder of its kind, the rest unchanged; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for s in find(text, field):
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


def found_spans(messages: DataFrame, key: str = "row_id", fields: tuple[str, ...] = ("message", "sender_ph")) -> DataFrame:
    """(key, field_name, kind, start_pos, end_pos): one row per occurrence in each stored row; map-only, in Arrow batches.

    Texts without a letter or digit are dropped in the JVM before any goes to Python.
    """
    schema = f"{key} string, field_name string, kind string, start_pos int, end_pos int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, name, s.kind, s.start, s.end) for name in fields for k, text in zip(part[key], part[name], strict=True) if text for s in find(text, name)]
            yield pd.DataFrame(rows, columns=[key, "field_name", "kind", "start_pos", "end_pos"])

    ship()
    some = None
    for f in fields:
        has = F.col(f).rlike(r"[\p{L}\p{N}]")
        some = has if some is None else some | has
    # keys go through pandas as text: beside a null they would become floats and lose digits
    found = spread(messages.filter(some).select(F.col(key).cast("string").alias(key), *fields)).mapInPandas(run, schema)
    return found.withColumn(key, F.col(key).cast(messages.schema[key].dataType))


def redacted(messages: DataFrame, fields: tuple[str, ...] = ("message", "sender_ph")) -> DataFrame:
    """``messages`` with the findings of ``fields`` replaced by placeholders; other columns are kept as they are."""

    ship()

    def run(field: str):
        @F.pandas_udf("string")
        def one(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: redact(t, field), na_action="ignore")

        return one(F.col(field))

    return spread(messages).withColumns({f: run(f) for f in fields})
