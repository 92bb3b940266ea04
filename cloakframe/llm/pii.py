"""Problem 2: personal information inside free text.

Regular expressions, a gazetteer taken from the corpus's own name columns, and
the words around a span propose candidates, generously, and vote for or against
each of them or abstain. Expectation-maximisation over the counts of vote
patterns estimates how reliable each voter is; all it is told beforehand is
that a vote is more often right than wrong. The posteriors of a bounded sample
of candidates train a logistic span classifier, which sees the votes and the
span itself, its shape, its neighbours and its place, and decides every span.
The counts cover all candidates of all texts; the driver sees one row per vote
pattern and the sample.

Defined results: null and blank texts have no spans; repeated deliveries of a
key count once; spans of one text never overlap; a text of any length is read
whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: A name token must make up this share of all name tokens to enter the gazetteer, so the list has at most 1 / SUPPORT entries.
SUPPORT = 2e-5
#: Deliveries that a token needs at least, whatever the share.
LEAST = 3

TITLES = frozenset("mr mrs ms miss dr prof mx".split())
RELATIONS = frozenset("brother sister twin cousin friend step-brother step-sister stepbrother stepsister carer grandparent nan gran grandad grandma mum dad mother father uncle aunt parent guardian worker teacher tutor".split())
#: Words after which, or before which, a capitalised word of no known spelling may be a name.
STRONG_LEFT = frozenset("with praise could cc".split()) | RELATIONS
STRONG_RIGHT = frozenset("gave has must signed attends started".split())
LEFT_CUES = frozenset("with to by for from and cc praise could today after than see tell ask support helped beside either referred seen spoke dear is of when not".split())
RIGHT_CUES = frozenset("is was has had must can could should did does gave came read signed attends started left rang runs asked informed needs works wants will's said seems".split())
IDIOM = frozenset("of to under ahead scheme schemes discussion discussions need be see missing the a in on for reading list and with report it".split())
#: Ordinary words that are also first names.
AMBIGUOUS = frozenset("mark will rose grace hope miles frank jack bill kit may april june summer page lane art faith joy dawn rob pat sue ray drew chase grant ward penny ruby ivy iris daisy holly".split())
NOT_NAMES = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday fridays mondays tuesdays wednesdays thursdays january february march april june july august september october november december "
    "year paper street road lane way school english maths science history geography french german nhs upn ni nino passport i".split()
)
ID_WORDS = r"NHS|UPN|ULN|UCI|NINO|NI|passport|cand(?:idate)?|adm(?:ission)?|insurance|pupil|health"
STREETS = r"Way|Road|Rd|Street|St|Crescent|Cres|Terrace|Hill|Drive|Dr|Court|Ct|Avenue|Ave|Lane|Ln|Close|Gardens|Grove|Place|Row|Rise|Walk|Green|Mews|Parade|Square"
POSTCODE = r"[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}"

EMAIL = re.compile(r"(?<![\w.+\-])[\w.+\-]+(?:\s?@\s?|\s?\[\s?at\s?\]\s?|\s?\(\s?at\s?\)\s?|\sat\s(?=[\w\-]+(?:\sdot\s|\.)))[A-Za-z0-9\-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[A-Za-z0-9\-]+)+")
PHONE = re.compile(r"(?<![\w.\-/])(?:(?:\+|00)\s?44\s?(?:\(0\)\s?)?|\(?0)(?:[ .\-()]{0,2}\d){9,10}(?!\d)(?:,?\s?(?:ext|extension|x)\.?\s?\d{1,5})?", re.I)
LABELLED = re.compile(rf"\b({ID_WORDS})\b\.?(?:\s*(?:no|num|number|ref|#)\b\.?)?\s*:?\s*([A-Z]{{0,2}}\s?\d[\d \-]*\d(?:\s?[A-D]\b)?)", re.I)
BARE_ID = re.compile(r"\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b|\b[A-Z]\s?\d{3}\s?\d{4}\s?\d{5}\b|\b[A-Z]{2}\d{7}\b|(?<![\d\-])\d{3}[ \-]\d{3}[ \-]\d{4}(?![\d\-])")
NUMBERED = re.compile(r"\b([A-Za-z]+)\s+(?:no|number|code)\b\.?\s*(\d[\d\-]{3,}\d)", re.I)
_NAMED = r"[^\W\d_a-z][\w'’]*"
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite)\.?\s?\d+[A-Za-z]?"
_LOWER = r"(?!(?:of|the|a|in|on|for|and|to|at|from|by|more|per|is|was)\s)[^\W\d_A-Z][\w'’]+"
ADDRESS = re.compile(
    rf"(?:(?:(?:{_UNIT},?\s)?(?:[Nn]o\.?\s?|[Nn]umber\s)?\d{{1,4}}[A-Za-z]?,?\s|{_UNIT},\s|(?:[Nn]umber\s\d+\s{_NAMED}|(?:[Tt]he\s)?{_NAMED}(?:\s{_NAMED})?),\s)(?:{_NAMED}\s)+"
    rf"|(?:{_UNIT},?\s)?(?:[Nn]o\.?\s?|[Nn]umber\s)?\d{{1,4}}[A-Za-z]?,?\s(?:{_LOWER}\s){{1,2}})"
    rf"(?i:{STREETS})\b\.?(?:,\s(?!(?i:page|see|and|the)\b){_NAMED}(?=,|[\s.;:!?)]|$)|\s{_NAMED}(?=,?\s{POSTCODE}))?(?:,?\s{POSTCODE})?"
)
_LETTERS = r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff])*"
TOKEN = re.compile(rf"{_LETTERS}(?:['’\-]{_LETTERS})*")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: A text without any of these and without a gazetteer word holds no candidate.
SIGNS = re.compile(r"[\d@]|\sdot\s|\[\s?at\s?\]|(?<=[\w,;:(] )[^\W\d_a-z]|\b(?:[Mm][Rr][Ss]?|[Mm][Ss]|[Mm][Ii][Ss][Ss]|[Dd][Rr])\b")
_ADDRESS_CUE = re.compile(r"(?:live[sd]?|living|moved|post|home|address|staying|stay|taxi|write|fire|house|dad|mum|gran|at|to|from)\W*(?:\w+\W+){0,4}$", re.I)
_PHONE_CUE = re.compile(r"(?:ring|rang|tel|call|mobile|phone|text|voicemail|answer|contact|reach|number|was|on)\b.{0,24}$", re.I)
_MAIL_CUE = re.compile(r"(?:mail|contact|write|writes|use|not|reply|from|to|ask|file|/)\W.{0,20}$|<$", re.I)
#: Generous candidates: anything with an at sign, any longer run of digits, capitalised words before a street word.
_ANY_MAIL = re.compile(r"[\w.+\-]+\s?@\s?[\w.:'\-]+")
_ANY_NUMBER = re.compile(r"(?<![\w.\-/])[(+]?\d(?:[ .\-()/]{0,2}\d){5,14}(?![\w])")
_ANY_ADDRESS = re.compile(rf"(?<!\w)(?:\d{{1,4}}[A-Za-z]?,?\s)?{_NAMED}\s(?:{STREETS})(?!\w)")
_DIGIT, _STREET = re.compile(r"\d"), re.compile(rf"\s(?i:{STREETS})(?!\w)")
_THING = re.compile(r"\b(?:calculator|locker|textbook|book|code|room|version|page|chapter|paper|room|code|isbn|laptop|order)\W*(?:\w+\W+){0,1}$", re.I)


def gazetteer(names: DataFrame, column: str) -> tuple[frozenset[str], frozenset[str]]:
    """First and last tokens of a name column, each common enough to be trusted; at most 1 / SUPPORT of either."""
    from cloakframe.sources.tables import settle

    n = F.trim(F.regexp_replace(F.lower(F.col(column)), r"\s+", " "))
    straight = names.select(F.split(n, " ").alias("t")).filter(~F.exists("t", lambda x: x.endswith(",")))
    ends = straight.filter(F.size("t") == 2).select(F.explode(F.array(F.struct(F.lit("first").alias("place"), F.col("t")[0].alias("token")), F.struct(F.lit("last").alias("place"), F.col("t")[1].alias("token")))).alias("x")).select("x.*")
    counted = settle(ends.groupBy("place", "token").agg(F.count("*").alias("n")), "gazetteer")
    total = counted.groupBy("place").agg(F.sum("n").alias("total"))
    kept = counted.join(total, "place").filter((F.col("n") >= F.col("total") * SUPPORT) & (F.col("n") >= LEAST) & (F.length("token") >= 2)).select("place", "token", "n").collect()
    count = {p: {r["token"]: r["n"] for r in kept if r["place"] == p} for p in ("first", "last")}
    # names typed in the other order put a few tokens in the wrong place
    first = {t for t, k in count["first"].items() if k >= 0.05 * count["last"].get(t, 0)}
    last = {t for t, k in count["last"].items() if k >= 0.05 * count["first"].get(t, 0)}
    return frozenset(first), frozenset(last)


#: Hash buckets of the classifier's features.
FEATURES = 1 << 13
_BEFORE, _AFTER = re.compile(r"(\w*)(\W*)$"), re.compile(r"(\W*)(\w*)")
_SHAPES = str.maketrans({**dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "x"), **dict.fromkeys("0123456789", "9")})


def features(text: str, a: int, b: int) -> list[int]:
    """Buckets of what a span looks like, of the words beside it, and of its place in the sentence."""
    left, right = _BEFORE.search(text[max(0, a - 25) : a]), _AFTER.match(text[b : b + 25])
    span = text[a:b]
    shape = re.sub(r"(.)\1+", r"\1+", span.translate(_SHAPES))
    gap = left[2].strip()
    place = "start" if a == 0 or gap[-1:] in tuple(".!?;:-\n") and gap else "in"
    own = span.lower() if " " not in span else span.lower().rpartition(" ")[2]
    seen = (f"l {left[1].lower()}", f"r {right[2].lower()}", f"s {shape[:40]}", f"p {place} {right[1].strip()[:1]}", f"w {own}")
    return [zlib.crc32(x.encode()) % FEATURES for x in seen]


class Finder:
    """Candidates of one text with the votes on each."""

    def __init__(self, first: frozenset[str], last: frozenset[str]) -> None:
        self.first, self.last = first, last
        self.known = first | last
        self.near = {t[:i] + t[i + 1 :] for t in last | first if len(t) >= 4 for i in range(len(t))}

    def like(self, token: str) -> bool:
        """Whether a token is in the gazetteer or one edit from it."""
        return token in self.known or token in self.near or any(token[:i] + token[i + 1 :] in self.known or (len(token) >= 5 and token[:i] + token[i + 1 :] in self.near) for i in range(len(token)))

    def __call__(self, text: str) -> list[tuple[str, int, int, str, list[int]]]:
        tokens = None
        if not SIGNS.search(text):
            tokens = [m for m in TOKEN.finditer(text)]
            if not any(self._core(m[0]) in self.known for m in tokens if m[0][0].isupper()):
                return []
        out: list[tuple[str, int, int, str]] = []
        taken: list[tuple[int, int]] = []
        if "@" in text or "at" in text:
            self._emails(text, out, taken)
        if _DIGIT.search(text):
            self._numbers(text, out, taken)
        if _STREET.search(text):
            self._addresses(text, out, taken)
        self._names(text, tokens, out, taken)
        return out

    @staticmethod
    def _core(token: str) -> str:
        t = token.lower()
        if not t.isascii():
            t = unicodedata.normalize("NFKC", _HIDDEN.sub("", t))
        return t[:-2] if t.endswith(("'s", "’s")) else t

    @staticmethod
    def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def _emails(self, text, out, taken) -> None:
        for m in EMAIL.finditer(text):
            host = re.split(r"@|\[\s?at\s?\]|\(\s?at\s?\)|\sat\s", m[0])[-1].strip()
            top = re.split(r"\.|dot", host)[-1].strip(" ]()")
            self._keep("email", text, m.start(), m.end(), (1, 1 if top.isalpha() and len(top) >= 2 else -1, 1 if _MAIL_CUE.search(text, max(0, m.start() - 30), m.start()) else 0), out, taken)
        for m in _ANY_MAIL.finditer(text):
            if self._free(taken, *m.span()):
                top = m[0].rpartition(".")[2] if "." in m[0] else ""
                self._keep("email", text, m.start(), m.end(), (-1, 1 if top.isalpha() and len(top) >= 2 else -1, 1 if _MAIL_CUE.search(text, max(0, m.start() - 30), m.start()) else 0), out, taken)

    def _numbers(self, text, out, taken) -> None:
        spans = []
        for r, labelled in ((LABELLED, True), (BARE_ID, False), (NUMBERED, False)):
            for m in r.finditer(text):
                digits = sum(c.isdigit() for c in m[0])
                if digits < 4:
                    continue
                thing = not labelled and (r is NUMBERED and not re.match(ID_WORDS, m[1], re.I) or _THING.search(text, max(0, m.start() - 30), m.start()))
                bare = BARE_ID.search(m[0])
                spans.append((m.start(), -m.end(), (1 if labelled else 0, 1 if bare else 0, -1 if thing else 0, 1 if re.search(r"\b(?:entered|check|quote|form|record|label|register|sheet|access)\b", text[max(0, m.start() - 30) : m.end() + 25], re.I) else 0)))
        for a, b, votes in sorted(spans, key=lambda x: (x[0], x[1], tuple(-y for y in x[2]))):
            if self._free(taken, a, -b):
                self._keep("id_number", text, a, -b, votes, out, taken)
        for m in PHONE.finditer(text):
            if self._free(taken, *m.span()):
                body = re.split(r"ext|x", m[0], flags=re.I)[0]
                digits = sum(c.isdigit() for c in body)
                shape = 1 if digits in ((12, 13) if "+" in body else (14, 15) if body.startswith("00") else (10, 11)) else -1
                self._keep("phone", text, *m.span(), (1, shape, *self._around_phone(text, m)), out, taken)
        for m in _ANY_NUMBER.finditer(text):
            if self._free(taken, *m.span()) and (digits := sum(c.isdigit() for c in m[0])) >= 6:
                self._keep("phone", text, *m.span(), (-1, 1 if 10 <= digits <= 13 and m[0].lstrip("(")[0] in "0+" else -1, *self._around_phone(text, m)), out, taken)

    @staticmethod
    def _around_phone(text: str, m: re.Match) -> tuple[int, int]:
        return 1 if _PHONE_CUE.search(text, max(0, m.start() - 40), m.start()) else 0, -1 if _THING.search(text, max(0, m.start() - 30), m.start()) else 0

    @staticmethod
    def _keep(kind: str, text: str, a: int, b: int, votes: tuple[int, ...], out: list, taken: list) -> None:
        out.append((kind, a, b, ",".join(map(str, votes)), features(text, a, b)))
        taken.append((a, b))

    def _addresses(self, text, out, taken) -> None:
        for m in ADDRESS.finditer(text):
            a, b = m.span()
            if not self._free(taken, a, b):
                continue
            before = text[max(0, a - 45) : a]
            votes = (
                1 if re.search(POSTCODE, m[0]) else 0,
                1 if re.match(r"(?:Flat|Apt|Apartment|Unit|Suite|no\b|\d)", m[0], re.I) else 0,
                1 if _ADDRESS_CUE.search(before) else 0,
                -1 if re.search(r"\b(?:page|chapter|question|lane|year|exercise)\W*$", before, re.I) else 0,
                1,
            )
            self._keep("address", text, a, b, votes, out, taken)
        for m in _ANY_ADDRESS.finditer(text):
            if self._free(taken, *m.span()):
                before = text[max(0, m.start() - 45) : m.start()]
                votes = (0, 1 if m[0][0].isdigit() else -1, 1 if _ADDRESS_CUE.search(before) else 0, -1 if re.search(r"\b(?:page|chapter|question|lane|year|exercise)\W*$", before, re.I) else 0, -1)
                self._keep("address", text, *m.span(), votes, out, taken)

    def _names(self, text, tokens, out, taken) -> None:
        tokens = tokens if tokens is not None else list(TOKEN.finditer(text))
        n, i = len(tokens), 0
        while i < n:
            m = tokens[i]
            word = m[0]
            low = word.lower()
            if not self._free(taken, *m.span()) if taken else False:
                i += 1
                continue
            j = self._titled(text, tokens, i, n) if low in TITLES else 0
            if j:
                self._emit(text, tokens, i, j, True, out, taken)
                i = j
                continue
            if not self._capital(word) or low in TITLES:
                i += 1
                continue
            core = self._core(word)
            start = self._starts_sentence(text, m.start())
            if core in self.known or (not start and core not in NOT_NAMES and len(core) > 1 and (self._cue(text, tokens, i) and self.like(core) or self._stranger(text, tokens, i))):
                j = self._run(text, tokens, i, n)
                self._emit(text, tokens, i, j, False, out, taken)
                i = j
            elif (not start or core in AMBIGUOUS or self.like(core)) and i + 1 < n and core not in NOT_NAMES and len(core) > 1 and self._gap(text, tokens, i) == " " and self._capital(tokens[i + 1][0]) and self._core(tokens[i + 1][0]) in self.last and self._free(taken, *tokens[i + 1].span()):
                j = self._run(text, tokens, i, n)
                self._emit(text, tokens, i, j, False, out, taken)
                i = j
            elif core not in NOT_NAMES and len(core) > 1 and i + 1 < n and self._gap(text, tokens, i) == " " and len(tokens[i + 1][0]) == 1 and tokens[i + 1][0].isupper() and text[tokens[i + 1].end() : tokens[i + 1].end() + 1] == "." and not start:
                self._emit(text, tokens, i, i + 2, False, out, taken)
                i += 2
            elif not start and len(core) > 1 and word[0].isupper():
                self._emit(text, tokens, i, i + 1, False, out, taken)
                i += 1
            else:
                i += 1

    @staticmethod
    def _capital(word: str) -> bool:
        return word[0].isupper() or (not word.isalpha() and any(p[:1].isupper() for p in re.split(r"[-'’]", word)[1:]))

    @staticmethod
    def _gap(text, tokens, i) -> str:
        return text[tokens[i].end() : tokens[i + 1].start()] if i + 1 < len(tokens) else ""

    @staticmethod
    def _starts_sentence(text: str, at: int) -> bool:
        before = text[max(0, at - 12) : at].rstrip(" ")
        return not before or before[-1] in ".!?;:-\n\"“"

    def _cue(self, text, tokens, i) -> bool:
        if i == 0:
            return False
        gap = text[tokens[i - 1].end() : tokens[i].start()]
        prev = tokens[i - 1][0].lower()
        return gap in (" ", ", ", " (", ": ") and (prev in LEFT_CUES or prev in RELATIONS)

    def _stranger(self, text, tokens, i) -> bool:
        """A capitalised word of unknown spelling where only a person fits."""
        if len(tokens[i][0]) < 3 or not tokens[i][0][1:].islower():
            return False
        before = i > 0 and self._gap(text, tokens, i - 1) in (" ", ", ") and tokens[i - 1][0].lower() in STRONG_LEFT
        after = i + 1 < len(tokens) and self._gap(text, tokens, i) == " " and tokens[i + 1][0] in STRONG_RIGHT
        return before or after

    def _titled(self, text, tokens, i, n) -> int:
        """End of the run after a title, 0 if no name follows."""
        gap = self._gap(text, tokens, i)
        if i + 1 >= n or gap not in (" ", ". ", "  "):
            return 0
        title, j = tokens[i][0], i + 1
        lower = title.islower()
        while j < n:
            word = tokens[j][0]
            core = self._core(word)
            if j > i + 1:
                gap = self._gap(text, tokens, j - 1)
                if not (gap == " " or (gap in (". ", ".") and len(tokens[j - 1][0]) == 1)) or tokens[j - 1][0].lower().endswith(("'s", "’s")):
                    break
            good = len(word) == 1 if word.isupper() and len(word) == 1 else self.like(core) if lower or not self._capital(word) else (core not in NOT_NAMES or core in self.known)
            if not good:
                break
            j += 1
        return j if j > i + 1 else 0

    def _run(self, text, tokens, i, n) -> int:
        j = i + 1
        while j < n:
            word, gap = tokens[j][0], self._gap(text, tokens, j - 1)
            core = self._core(word)
            if tokens[j - 1][0].lower().endswith(("'s", "’s")):
                break
            if gap in (". ", ".") and len(tokens[j - 1][0]) == 1 and self._capital(word) and (core in self.known or self.like(core)):
                j += 1
            elif gap == " " and self._capital(word) and core not in NOT_NAMES and core not in TITLES and (core in self.known or len(word) == 1 or self.like(core)):
                j += 1
            elif gap == ", " and j == i + 1 and self._capital(word) and (core in self.first or text[tokens[j].end() : tokens[j].end() + 1] == ":") and self._core(tokens[j - 1][0]) in self.last and self._core(tokens[j - 1][0]) not in self.first:
                j += 1
            else:
                break
        return j

    def _emit(self, text, tokens, i, j, titled, out, taken) -> None:
        words = [t[0] for t in tokens[i:j]]
        body = words[1:] if titled else words
        cores = [self._core(w) for w in body]
        a, b = tokens[i].start(), tokens[j - 1].end()
        possessive = words[-1].lower().endswith(("'s", "’s"))
        if possessive:
            b -= 2
        start = self._starts_sentence(text, a)
        after = text[b : b + 20]
        follow = TOKEN.search(after)
        nxt = follow[0].lower() if follow and after[: follow.start()] in (" ", "") else ""
        ambiguous = len(body) == 1 and not titled and cores[0] in AMBIGUOUS and not (body[0].isupper() and len(body[0]) > 1)
        votes = (
            1 if titled else 0,
            1 if any(c in self.first for c in cores) else 0,
            1 if any(c in self.last and c not in self.first for c in cores) else 0,
            1 if self._cue(text, tokens, i) else 0,
            1 if possessive or nxt in RIGHT_CUES or re.match(r" \(|[,!?):]", after) else -1 if ambiguous and (nxt in IDIOM or nxt in ("discussion", "scheme")) else 0,
            1 if len(body) > 1 else 0,
            -1 if ambiguous and start and not (possessive or nxt in RIGHT_CUES or after[:1] == ":") else 0,
            0 if titled or any(c in self.known for c in cores) else 1 if any(self.like(c) for c in cores) else -1,
            -1 if len(cores) == 1 and cores[0] in NOT_NAMES else 1 if not titled and len(cores) == 1 and self._stranger(text, tokens, i) else 0,
        )
        self._keep("name", text, a, b, votes, out, taken)


def candidates(rows: DataFrame, key: str, text: str, first: frozenset[str], last: frozenset[str]) -> DataFrame:
    """(key, kind, start, stop, votes) of every candidate span, in code points from 0."""

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(first, last)
        seen: dict[str, list] = {}
        columns = ["k", "kind", "start", "stop", "votes", "features"]
        for b in batches:
            rows = []
            for k, t in zip(b["k"].tolist(), b["t"].tolist(), strict=True):
                spans = seen.get(t)
                if spans is None:
                    spans = finder(t)
                    if len(seen) > 100_000:  # memory only
                        seen.clear()
                    if len(t) < 1_000:
                        seen[t] = spans
                rows.extend((k, *x) for x in spans)
            if rows:
                yield pd.DataFrame(dict(zip(columns, zip(*rows, strict=True), strict=True)), columns=columns)

    source = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").filter(F.col("t").rlike(r"[\p{L}\p{N}]"))
    kind = dict(source.dtypes)["k"]
    return source.mapInPandas(find, f"k {kind}, kind string, start int, stop int, votes string, features array<int>")


#: Candidates' worth of the belief that a vote is more often right than wrong: against, silent, for.
BELIEF = 100.0
RIGHT = np.array([0.1, 0.5, 0.4])
#: Candidates, about so many of each kind, on whose posteriors the classifier is trained, and its rounds.
TRAINED, ROUNDS = 20_000, 300


def votes_of(patterns: list[str]) -> np.ndarray:
    """Pattern x voter x (against, silent, for)."""
    v = np.array([[int(x) for x in p.split(",")] for p in patterns])
    return np.stack([v == -1, v == 0, v == 1], axis=2).astype(float)


def estimate(counts: dict[str, float], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """Probability that a candidate with each vote pattern is personal information, and each voter's reliability.

    Expectation-maximisation with independent voters from the majority of the
    votes. The reliability of a voter is the share of right votes among those
    it cast.
    """
    if not counts:
        return {}, np.zeros(0)
    patterns = sorted(counts)
    hot = votes_of(patterns)
    n = np.array([float(counts[p]) for p in patterns])
    total = n.sum()
    post = 1 / (1 + np.exp(-2.0 * (hot[:, :, 2] - hot[:, :, 0]).sum(axis=1)))
    for _ in range(rounds):
        no, yes = ((np.einsum("p,pvc->vc", w, hot) + BELIEF * belief) / (w.sum() + BELIEF) for w, belief in ((n * (1 - post), RIGHT[::-1]), (n * post, RIGHT)))
        prior = (n @ post + BELIEF / 2) / (total + BELIEF)
        log = [np.einsum("pvc,vc->p", hot, np.log(np.maximum(e, 1e-9))) for e in (no, yes)]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log1p(-prior) - np.log(prior), -50, 50)))
    right = np.einsum("p,pv->v", n * post, hot[:, :, 2]) + np.einsum("p,pv->v", n * (1 - post), hot[:, :, 0])
    cast = np.einsum("p,pv->v", n, hot[:, :, 2] + hot[:, :, 0])
    return dict(zip(patterns, post.tolist(), strict=True)), (right + BELIEF / 2) / (cast + BELIEF)


class Classifier:
    """Logistic regression of a span on its votes and on its features, the features held back so that votes come first."""

    def __init__(self, patterns: list[str], features: list[list[int]], target: np.ndarray) -> None:
        self.voters = len(patterns[0].split(","))
        x, f = self._matrix(patterns), np.asarray(features, dtype=np.int64)
        self.weight, self.feature, n = np.zeros(x.shape[1]), np.zeros(FEATURES), len(patterns)
        speed, speeds = np.full(x.shape[1], 1e-6), np.full(FEATURES, 1e-6)
        for _ in range(ROUNDS):  # gradient steps scaled by their past
            error = self._odds(x, f) - target
            g = x.T @ error / n + 1e-5 * self.weight
            h = np.bincount(f.ravel(), np.repeat(error, f.shape[1]), FEATURES) / n + 1e-4 * self.feature
            speed += g * g
            speeds += h * h
            self.weight -= 0.3 * g / np.sqrt(speed)
            self.feature -= 0.1 * h / np.sqrt(speeds)

    def _matrix(self, patterns: list[str]) -> np.ndarray:
        hot = votes_of(patterns)
        return np.concatenate([np.ones((len(patterns), 1)), hot[:, :, 0], hot[:, :, 2]], axis=1)

    def _odds(self, x: np.ndarray, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.feature[f].sum(axis=1), -30, 30)))

    def __call__(self, patterns: list[str], features: np.ndarray) -> np.ndarray:
        known = {p: i for i, p in enumerate(dict.fromkeys(patterns))}
        base = self._matrix(list(known)) @ self.weight
        at = np.fromiter((known[p] for p in patterns), dtype=np.int64, count=len(patterns))
        return 1 / (1 + np.exp(-np.clip(base[at] + self.feature[features].sum(axis=1), -30, 30)))


def classifiers(spans: DataFrame) -> dict[str, Classifier]:
    """The span classifier of each kind of candidate (key, kind, start, stop, votes, features) of a written table."""
    counted = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    per = {k: {r["votes"]: r["n"] for r in counted if r["kind"] == k} for k in KINDS}
    share = {k: min(1.0, TRAINED / max(1, sum(c.values()))) for k, c in per.items()}
    part = F.pmod(F.xxhash64("k", "start"), F.lit(1 << 30))
    wanted = F.create_map(*(F.lit(x) for k, p in share.items() for x in (k, max(1, int(p * (1 << 30))))))
    # what differs little counts once with its number, so that copies of one row cannot fill the sample
    rows = spans.filter(part < wanted[F.col("kind")]).select("kind", "votes", "features").limit(2 * TRAINED * len(KINDS)).collect()
    out = {}
    for k, counts in per.items():
        own = [r for r in rows if r["kind"] == k] or [r for r in spans.filter(F.col("kind") == k).limit(100).collect()]
        if own:
            post, _ = estimate(counts)
            own.sort(key=lambda r: (r["votes"], r["features"]))
            out[k] = Classifier([r["votes"] for r in own], [r["features"] for r in own], np.array([post[r["votes"]] for r in own]))
    return out


#: Place of the voter that a word is spelled like a name. A word that makes up this share of all such words, and is seen so many
#: times, is a word of its own and no slip: there are at most 1 / OFTEN of them.
SPELLED, OFTEN, SEEN = 7, 0.02, 5


def spelling_checked(spans: DataFrame) -> DataFrame:
    """The candidates, with the vote for a slip of a name turned against words too frequent to be slips."""
    votes, word = F.split("votes", ","), F.col("features")[4]
    like = (F.col("kind") == "name") & (F.try_element_at(votes, F.lit(SPELLED + 1)) == "1")
    counted = spans.filter(like).groupBy(word.alias("w")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = [r["w"] for r in counted.filter(F.col("n") >= max(SEEN, OFTEN * total)).collect()]
    if not often:
        return spans
    turned = F.array_join(F.transform(votes, lambda v, i: F.when(i == SPELLED, "-1").otherwise(v)), ",")
    return spans.withColumn("votes", F.when(like & word.isin(often), turned).otherwise(F.col("votes")))


def judged(spans: DataFrame) -> DataFrame:
    """The candidates (k, kind, start, stop) that the classifier of their kind accepts; ``spans`` is a written table."""
    spans = spelling_checked(spans)
    judges = classifiers(spans)

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            kinds = b["kind"].to_numpy()
            for kind, one in judges.items():
                at = np.flatnonzero(kinds == kind)
                if len(at):
                    keep[at] = one(b["votes"].to_numpy()[at].tolist(), np.stack(b["features"].to_numpy()[at])) >= 0.5
            yield b.loc[keep, ["k", "kind", "start", "stop"]]

    return spans.mapInPandas(judge, f"k {dict(spans.dtypes)['k']}, kind string, start int, stop int")


def personal_spans(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, kind, start, stop) of the personal information in ``text``."""
    from cloakframe.sources.tables import settle

    first, last = gazetteer(names, name)
    spans = settle(candidates(rows, key, text, first, last), "spans")
    return judged(spans).select(F.col("k").alias(key), "kind", "start", "stop")


def numbered(spans: DataFrame, key: str) -> DataFrame:
    """(key, kind, seq): 1, 2, ... of each kind within a text, in reading order."""
    counts = spans.groupBy(key, "kind").agg(F.countDistinct("start").cast("int").alias("n"))
    return counts.select(key, "kind", F.explode(F.sequence(F.lit(1), "n")).alias("seq"))


def redact(rows: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """The rows with every accepted span replaced by its placeholder and all else unchanged.

    ``spans`` are grouped by key (as many as one text holds) and folded into
    the text from the last to the first inside the JVM.
    """
    label = F.create_map(*(F.lit(x) for kv in PLACEHOLDERS.items() for x in kv))
    per = spans.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_set(F.struct("start", "stop", label[F.col("kind")].alias("label"))), asc=False).alias("_spans"))
    old = F.col(text)
    folded = F.aggregate("_spans", old, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["label"], F.substring(t, s["stop"] + 1, F.length(t))))
    joined = rows.join(per, rows[key] == F.col("_key"), "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), old).otherwise(folded)).drop("_key", "_spans")
