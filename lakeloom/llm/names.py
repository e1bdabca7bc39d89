"""Names of persons in free text of any case: words that no vocabulary has in lower case, weighed by what stands around them.

A public vocabulary of frequent words is the lexicon: a word that it has in lower case is ordinary, one that it has only
(or far sooner) with a capital is a proper name, and one that it lacks is unknown. Candidates are titles, given names and
surnames in a row; words on both sides, marks of other findings and the borders of the clause raise their score.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from .tokens import FOLDER

ORDINARY, PROPER, FOREIGN, UNKNOWN = range(4)
#: Files of the lexicon below the folder of public vocabularies: the main language, and many languages.
FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

_L = r"[^\W\d_]"
_UPPER = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Lu", "Lt"))
WORD = re.compile(rf"{_L}+(?:['’-]{_L}+)*")

#: Titles before a name.
TITLES = frozenset("mr mrs ms miss mx dr prof frau herr mme mlle sra sr señora señor pan pani sir dame".split())
#: Small words inside a surname.
PARTICLES = frozenset("van von der den de la del di da dos bin ibn al ter ten le el".split())
#: Words that are given names as well as ordinary words.
BOTH = frozenset("ann ed jo meg mel don len roy sal ted tim val vic amy deb hal miles penny phil rod ruth sandy todd anders ali li ming will mark grace rose faith hope joy april may june august jack bill frank grant victor art rich dawn ivy lily ruby amber crystal daisy pearl summer chase hunter mason carter dean gene ray pat sue drew guy josh rob nick max tony christian ben tom lin una mira kim sam jay lee".split())
#: Of these, names of months: alone they are no persons.
MONTHS = frozenset("april may june august".split())
#: Proper names that are no persons: days, months, languages and peoples, places.
NO_PERSONS = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march july september october november december "
    "english french german spanish italian polish dutch portuguese russian chinese japanese korean arabic turkish greek latin american british european african asian indian canadian australian mexican swiss swedish "
    "europe africa asia america australia england france germany spain italy poland russia china japan india canada mexico brazil britain ireland scotland switzerland sweden norway denmark "
    "london paris berlin madrid rome vienna prague warsaw dublin lisbon amsterdam brussels moscow tokyo beijing delhi mumbai sydney toronto chicago boston seattle york washington oxford cambridge hamburg munich zurich cairo francisco angeles vegas "
    "christmas easter".split()
)
#: Products and makers of the trade.
PRODUCTS = frozenset(
    "apache microsoft google amazon oracle facebook twitter apple intel nvidia netflix azure kafka hadoop hive iceberg hudi parquet python java scala kotlin golang rust linux windows ubuntu debian redhat docker kubernetes helm jenkins grafana prometheus airflow dagster prefect snowflake databricks postgres postgresql mysql mariadb "
    "sqlite mongodb cassandra redis elasticsearch kibana logstash elastic splunk datadog kinesis redshift athena bigquery dynamodb terraform ansible vagrant flink beam presto trino impala spark pyspark pandas numpy arrow pulsar rabbitmq zookeeper nginx envoy vault consul nomad excel slack jira confluence github gitlab bitbucket android "
    "chatgpt openai tableau looker superset metabase duckdb clickhouse druid pinot minio ceph lustre celery django flask quartz internet".split()
)
#: Terms and short forms of the trade and of chats that vocabularies lack.
TERMS = frozenset(
    "upsert upserts upserted ssn ni nino pk pks thx fwd apt tel repo repos cron yaml avro csv tsv psv orc json utc api url sql etl dag dags schema schemas metadata timestamp timestamps checksum checksums dataset datasets datastore namespace namespaces serde kubectl stdout stderr "
    "ok okay gib mib kib tib mb gb kb tb bis dedupe dedup deduped noop todo asap fyi btw imo lgtm eta oom gc jvm cpu gpu ssd nfs hdfs sha md hilbert luhn nope yep yeah yup hmm hm uh um lol haha wow gonna wanna gotta dunno hiya pls plz ty np nvm".split()
)
#: Frequent words of other languages in chats, forms of streets and documents among them, that vocabularies lack.
WORDS = frozenset("lauf hängt stunden schicken relance récupéré dirección calle rue straße strasse steuer ausweis".split())

#: What stands behind the apostrophe of contractions.
SHORT_PARTS = frozenset("t ll re ve d m s".split())
#: Endings and beginnings that make words of words.
ENDINGS = ("s", "es", "ed", "d", "r", "er", "ers", "ing", "ion", "ions", "or", "ors", "ly", "ness", "able", "ment", "ments", "ful", "less", "y", "ies", "ied")
BEGINNINGS = ("re", "un", "pre", "non", "de", "dis", "mis", "over", "under", "sub", "super", "auto", "multi", "inter", "back", "up", "out", "down")

_Q = r"[\"“”'‘’(\[<]*"
#: Words before a person: prepositions, forms of address, verbs with a person as object, roles.
BEFORE = re.compile(
    r"(?:(?<![\w.+-])@|\b(?:by|to|from|with|for|via|per|cc|bcc|attn|ask|asks|asked|asking|tell|tells|told|ping|pinged|poke|call|called|calling|phone|email|mail|emailed|mailed|message|messaged|contact|contacted|meet|met|see|saw|notify|notified|remind|reminded|invite|invited|thank|thanks|thx|cheers|regards|greetings|"
    r"hey|hi|hello|dear|ok|okay|yes|yo|morning|evening|welcome|sorry|congrats|gruß|hallo|bonjour|hola|salut|liebe|lieber|servus|merci|danke|gracias|think|guess|believe|suspect|maybe|perhaps|probably|understood|obliged|agreed|sure|noted|roger|right|great|perfect|cool|nice|alright|fine|correct|indeed|appreciated|apologies|kudos|bye|goodbye|howdy|good day|add|include|involve|consult|nudge|through|who is|who's|"
    r"(?:loop|bring|pull|call|cc|patch|rope)(?:ed|s|ing)? in|in touch with|cover for|customer|client|user|colleague|teammate|manager|owner|reviewer|author|sender|recipient|employee|engineer|patient|tenant|subscriber|member|visitor|guest|contractor|analyst|shopper|buyer|holder|director|chief|agent|clerk|driver|seller|vendor|applicant|candidate|student|teacher|nurse|doctor|lawyer|boss|friend|brother|sister|"
    r"named|name is|name's|i am|i'm|am|this is|signed|approved|assigned|spoke|because of|thanks to|except|besides|instead of|against|like|let|lets|where's|and ask|"
    r"an|von|für|mit|bei|frage|frag|par|pour|avec|chez|para|con|por|przez|dla|od))[:,]? " + _Q + r"$|(?<![\w.+-])@$",
    re.I,
)
#: Roles that are followed by a form of to be before the name.
BEFORE_BE = re.compile(r"\b(?:reviewer|author|owner|contact|manager|sender|recipient|engineer|customer|client|lead|approver|winner|assignee|caller|it|that|person|name|wife|husband|boss) (?:is|was|were|will be|would be|has been|being) " + _Q + r"$", re.I)
#: Words behind a person: verbs that a person does.
AFTER = re.compile(
    r"^(?:[’']s\b|[’'](?= )|[\"”’')\]>]{0,2},? (?:can|could|could've|may|might|must|will|would|should|shall|please|pls|is|was|isn't|wasn't|has|had|hasn't|does|did|doesn't|didn't|do|don't|says|said|say|saw|sees|seen|sent|sends|wrote|writes|signed|signs|called|calls|knows|knew|thinks|thought|asked|asks|reported|reports|replied|replies|owns|owned|"
    r"confirmed|confirms|approved|approves|mentioned|mentions|needs|needed|wants|wanted|left|lives|lived|works|worked|told|tells|gave|gives|took|takes|got|gets|made|makes|found|finds|noticed|fixed|fixes|moved|merged|pushed|reviewed|reviews|promised|insists|insisted|claims|claimed|complained|agreed|agrees|"
    r"forgot|remembers|shows|showed|appears|turned|picked|looked|looks|handles|handled|handed|paid|pays|ordered|wired|joined|joins|resigned|retired|went|goes|came|comes|started|stopped|tried|tries|spotted|covers|covered|answered|answers|checked|checks|kept|keeps|runs|ran|whose|herself|himself|themselves|on call)\b|"
    r", (?:they|she|he|who|born|aged|please|can|could)\b|,? (?:born|aged)\b)",
    re.I,
)
#: What stands before and behind things rather than persons.
DETERMINER = re.compile(r"(?:\d |\b(?:the|a|an|this|these|those|each|every|any|some|no|its|their|our|my|your|many|few|several|more|most|all|both|other|another|such|two|three|der|die|das|dem|den|ein|eine|le|les|un|une|el|los|las)\s)$", re.I)
THING_BEFORE = re.compile(r"\b(?:in|into|at|on|of|im|am|lane|column|table|field|version|release|branch)\s$", re.I)
THING_AFTER = re.compile(r"^ (?:table|tables|column|columns|cluster|clusters|server|servers|service|database|api|query|queries|format|files?|jobs?|lake|stream|bucket|buckets|log|logs|pipeline|engine|runner|cache|index|partition|partitions|catalog|dashboard|release|version|isolation|spec|backfill|feed|street|road|lane|avenue)\b", re.I)
_CLAUSE = r"[.!?:;\n…|—–•\U0001F300-\U0001FAFF☀-➿]"
_WORDS_BEFORE = re.compile(rf"[^.!?:;\n…|—]*$")
_BREAK = re.compile(_CLAUSE)
_STARTS = re.compile(rf"(?:^|{_CLAUSE}️?\s*| - |[\"“(]\s*|->\s?)$")
_ENDS = re.compile(rf"^\s*(?:$|(?!:){_CLAUSE}| - )")
MARKS = "\x01\x02\x03\x04"
_MARK_BEFORE = re.compile(rf"[{MARKS}](?:\s*[-–—|;/]\s*|\s*\n\s*|[)\]>] ?)$")
_MARK_AFTER = re.compile(rf"^[\"”']?(?:\s*[,;|<(\[/:-]{{1,2}}\s*|\s*\n\s*|\s)(?:tel\.?:? ?|phone:? ?|mail:? ?)?[{MARKS}]", re.I)
_TOWN = re.compile(r"\x04,? ?$")
_INITIAL, _ONE = re.compile(rf"(?: {_L}\.)+(?= )"), re.compile(rf" {_L}\.?(?!\w)")


#: Ranks of the vocabulary up to which a word is common enough to be a part of a compound.
COMMON = 25_000


class Lexicon:
    """Kinds of words by two public vocabularies; the folder must be readable on every machine."""

    def __init__(self, folder: str = FOLDER):
        self.main, self.many = (self._ranks(os.path.join(folder, f)) for f in FILES)
        self._kind: dict[str, int] = {}

    @staticmethod
    def _ranks(path: str) -> dict[str, int]:
        """rank of each word that stands behind a space, as it is written."""
        out: dict[str, int] = {}
        with open(path, "rb") as f:
            for line in f:
                raw, rank = line.split()
                word = base64.b64decode(raw)
                if word[:1] == b" " and len(word) > 2:
                    try:
                        out[word[1:].decode()] = int(rank)
                    except UnicodeDecodeError:
                        continue  # a part of a character
        return out

    @staticmethod
    def _ordinary(ranks: dict[str, int], word: str) -> bool:
        low = ranks.get(word)
        return low is not None and low < 3 * ranks.get(word.capitalize(), low)

    def _made(self, word: str) -> bool:
        """Whether a word is an ordinary one with an ending or a beginning, or two joined."""
        known = lambda w: len(w) > 2 and self._ordinary(self.main, w)
        if any(word.endswith(e) and (known(stem := word[: -len(e)]) or known(stem + "e") or known(stem + "y") or (len(stem) > 3 and stem[-1] == stem[-2] and known(stem[:-1]))) for e in ENDINGS if len(word) > len(e) + 2):
            return True
        if any(word.startswith(b) and known(word[len(b) :]) for b in BEGINNINGS):
            return True
        common = lambda w: known(w) and self.main[w] < COMMON
        return any(common(word[:k]) and common(word[k:]) for k in range(4, len(word) - 3))

    def kind(self, word: str) -> int:
        """The kind of a word in lower case; one with signs inside is ordinary if its parts are."""
        k = self._kind.get(word)
        if k is None:
            written, word = word, unicodedata.normalize("NFKC", word).replace("’", "'")
            parts = re.split(r"['-]", word)
            if len(parts) > 1 and all(x in SHORT_PARTS or self.kind(x) == ORDINARY for x in parts[1:]) and self.kind(parts[0]) == ORDINARY:
                k = ORDINARY
            elif word in TERMS or word in WORDS or self._ordinary(self.main, word):
                k = ORDINARY
            elif (proper := self.main.get(word.capitalize())) is not None and not (self._ordinary(self.many, word) and self.many[word] < proper):
                k = PROPER
            elif len(word) > 2 and self._made(word):
                k = ORDINARY
            else:
                k = FOREIGN if self._ordinary(self.many, word) else UNKNOWN
            if len(self._kind) > 200_000:
                self._kind.clear()
            self._kind[written] = k
        return k


@lru_cache(maxsize=4)
def lexicon(folder: str = FOLDER) -> Lexicon:
    return Lexicon(folder)


class _Token:
    __slots__ = ("start", "end", "low", "style", "kind")

    def __init__(self, start: int, end: int, word: str, kind: int):
        self.start, self.end, self.low, self.kind = start, end, word.lower(), kind
        first = word[0]
        # a script without capitals tells nothing
        self.style = "none" if word.upper() == word.lower() else "lower" if not (first.isupper() or first.istitle()) else "upper" if len(word) > 1 and word.isupper() else "title" if word[1:].islower() or not re.search(rf"(?<![-'’])[{_UPPER}]", word[1:]) or word[:2] == "Mc" or word[:3] == "Mac" else "mixed"


def _tokens(text: str, words: Lexicon) -> list[_Token]:
    """Words that stand free, without those inside paths, identifiers and addresses."""
    out, n = [], len(text)
    for m in WORD.finditer(text):
        a, b = m.span()
        word = m.group()
        if word[-2:] in ("'s", "’s") and len(word) > 3:
            word, b = word[:-2], b - 2
        before = text[a - 1] if a else " "
        after = text[b] if b < n else " "
        if before.isalnum() or before in "_./\\=#$~%&" or (before == "-" and a > 1 and not text[a - 2].isspace()) or after == "_" or after.isdigit() or after in "/\\=" or (after in ".-:@" and b + 1 < n and (text[b + 1].isalnum() or text[b + 1] == "_")):
            if not (after in ":" and b + 1 < n and text[b + 1].isspace()):
                continue
        if after == "(" or before == "@" and a > 1 and (text[a - 2].isalnum() or text[a - 2] in "._-"):
            continue
        out.append(_Token(a, b, word, words.kind(word.lower())))
    return out


def _nameable(t: _Token) -> bool:
    return t.style not in ("mixed", "none") and t.low not in NO_PERSONS and t.low not in PRODUCTS and t.low not in TERMS and t.low not in WORDS and t.end - t.start > (2 if t.style == "lower" else 1)


def _person_word(t: _Token) -> bool:
    """A word that can be a name by itself."""
    return _nameable(t) and (t.kind != ORDINARY or (t.low in BOTH and t.style == "title"))


def names(text: str, folder: str = FOLDER) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of what may be names of persons; marks of other findings stand in the text as ``MARKS``."""
    words = lexicon(folder)
    toks = _tokens(text, words)
    if not toks:
        return
    clause, clauses = 0, []
    for n, t in enumerate(toks):
        clause += bool(n and _BREAK.search(text, toks[n - 1].end, t.start))
        clauses.append(clause)
    plain, foreign, total = ([0] * (clause + 1) for _ in range(3))
    for c, t in zip(clauses, toks, strict=True):
        plain[c] += t.kind == ORDINARY and t.low not in WORDS
        foreign[c] += t.kind == FOREIGN or t.low in WORDS
        total[c] += 1
    ordinary = sum(plain)
    i, last_end = 0, -9
    while i < len(toks):
        found = _candidate(text, toks, i)
        if found is None:
            i += 1
            continue
        start, end, title, used, upto = found
        c, rest = clauses[i], len(toks) - len(used)
        score = _score(text, start, end, title, used, plain[c] >= 2 and 2 * plain[c] >= total[c] - len(used) and not foreign[c], rest >= 3 and 2 * ordinary < rest, last_end)
        if score >= 0.5:
            last_end = end
            i = upto
            yield start, end, min(score, 1.0)
        else:
            i += 1


def _gap(text: str, a: _Token, b: _Token) -> str:
    return text[a.end : b.start]


def _candidate(text: str, toks: list[_Token], i: int):
    """The longest candidate that begins with word i: (start, end, title, words, next word)."""
    t = toks[i]
    n = len(toks)
    title = t.low in TITLES and i + 1 < n and _gap(text, t, toks[i + 1]) in (" ", ". ")
    k = i + 1 if title else i
    first = toks[k]
    if not _nameable(first) or first.low in TITLES:
        return None
    if not title and not _person_word(first):
        return None
    used, end, k = [first], first.end, k + 1
    style = first.style
    while k < n and len(used) < 4:
        m = _INITIAL.match(text, end)
        gap_end = m.end() if m else end
        t = toks[k]
        while t.start < gap_end and k + 1 < n:  # initials are words of one letter
            k += 1
            t = toks[k]
        gap = text[gap_end : t.start]
        if gap != " ":
            break
        if t.low in PARTICLES and t.style == "lower" and first.kind != ORDINARY:
            nxt = toks[k + 1] if k + 1 < n and _gap(text, t, toks[k + 1]) == " " else None
            if nxt is not None and (nxt.low in PARTICLES or (_nameable(nxt) and nxt.kind != ORDINARY)) or (style == "lower" and t.low in ("van", "von") and len(used) == 1):
                used.append(t)
                end, k = t.end, k + 1
                continue
            break
        surname = _person_word(t) or (style == "title" and t.style == "title" and _nameable(t) and (used[0].kind != ORDINARY or title))
        same = t.style == style or {t.style, style} <= {"title", "upper"}
        if not surname or not same or t.low in TITLES:
            break
        used.append(t)
        end, k = t.end, k + 1
    # surname, given name
    if len(used) == 1 and not title and k < n and _gap(text, used[0], toks[k]) == ", " and toks[k].style == style and _person_word(toks[k]) and used[0].kind != ORDINARY and toks[k].low not in TITLES:
        t = toks[k]
        m = _ONE.match(text, t.end)
        more = toks[k + 1] if k + 1 < n else None
        one = bool(m) and more is not None and more.start < m.end()
        stop = m.end() if one and (text[m.end() - 1] == "." or t.style != "lower") else t.end
        follows = toks[k + 2] if one and k + 2 < n else more
        if follows is None or not (text[stop : follows.start] in (" ", ", ", " and ", " & ") and _person_word(follows)):
            used.append(t)
            end, k = stop, k + (2 if stop > t.end else 1)
    return toks[i].start, end, title, used, k


def _score(text: str, start: int, end: int, title: bool, used: list[_Token], spoken: bool, mixed: bool, last_end: int) -> float:
    left, right = text[max(0, start - 30) : start], text[end : end + 24]
    opens = bool(_STARTS.search(left))
    first, several = used[0], len(used) > 1
    if _TOWN.search(left):
        return 0.0
    if not several and not title and first.low in MONTHS:
        return 0.0
    strange = sum(t.kind == FOREIGN and t.low not in BOTH for t in used)
    if title:
        s = 0.7
    elif first.style != "title":
        s = (0.3 if several else 0.2) + 0.1 * (first.kind == PROPER) - 0.1 * bool(strange)
        if several and spoken and all(t.kind in (UNKNOWN, PROPER) or t.low in PARTICLES for t in used):
            s += 0.2  # two unknown words in a row among ordinary ones
    else:
        s = 0.5 if several else 0.25 if opens else 0.3
        s += 0.05 * (first.kind == PROPER) - 0.25 * bool(strange) - 0.1 * (first.kind == ORDINARY and not several)
    joined = text[last_end:start] in (" or ", " and ", " & ", ", ", " / ", ", and ", " und ", " et ", " y ") if last_end >= 0 else False
    near = bool(BEFORE.search(left) or BEFORE_BE.search(left) or joined)
    behind = bool(AFTER.match(right))
    s += 0.3 * near + 0.3 * behind
    if mixed and first.style != "title" and not (title or near or behind or _MARK_AFTER.match(right)):
        s -= 0.15
    ends = _ENDS.match(right)
    if ends and ends.group()[-1:] == "\n" and first.style == "title" and right[ends.end() : ends.end() + 1].islower():
        ends = None  # a sentence that goes on in the next line
    if opens and ends:
        s += 0.3 if ends.group().strip() in ("?", "-", "–", "—") else 0.25
    elif opens and right[:1] == ":":
        s += 0.3
    elif ends and first.style == "title" and not several and not near:
        s += 0.2 * (len(_WORDS_BEFORE.search(left).group().split()) <= 2)  # a short clause that ends with an address
    if left[-1:] in ("“", '"', "«") and right[:1] in ("”", '"', "»"):
        s += 0.2
    beside = bool(_MARK_AFTER.match(right))
    if beside:
        s += 0.3
    elif _MARK_BEFORE.search(left):
        s += 0.2
    if not title and ((DETERMINER.search(left) and not near) or (THING_BEFORE.search(left) and not (near or behind or beside)) or THING_AFTER.match(right)):
        s -= 0.3
    return s
