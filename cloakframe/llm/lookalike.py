"""Problem 4: one consistent form for strings that look the same.

Strings and code points that look alike are edges of a graph; union-find gives
its transitive classes. Within a class the representative is a plain member of
the wanted script, the most frequent one in the corpus first. An automaton over
all other members rewrites a text greedily, leftmost and longest. Letters of
one script that are drawn alike (``ɡ`` and ``g``) give way to the more frequent
of them everywhere; letters of a style (``𝐑``, ``ſ``) give way within words; a
letter that only looks like one of another script is rewritten only inside a
word that mixes scripts (or that is written wholly in look-alikes amid the other
script), so that names and words of another script stay as they are.

Defined results: null stays null and has no row; an empty text stays empty;
what has no plain look-alike stays; the result is its own consistent form
(rewriting twice changes nothing).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts (Cyrillic, Greek, Armenian, Coptic, Cherokee) drawn like the Latin letter before them.
SCRIPT_LOOKALIKES = {
    "a": "аα", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "кκ", "l": "ӏ", "n": "ηո", "o": "оοօⲟ", "p": "рρ", "q": "ԛզ", "s": "ѕ",
    "t": "τ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү", "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹⲤᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "Ꮐ", "H": "НΗⲎᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ",
    "K": "КΚⲔᏦ", "L": "Ꮮ", "M": "МΜⲘᎷ", "N": "ΝⲚ", "O": "ОΟՕⲞ", "P": "РΡⲢᏢ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤⲦᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧⲬ", "Y": "УΥҮ", "Z": "ΖᏃ",
}
#: Names of Latin letters drawn like an ordinary one, which the name ends with; ALPHA is an ``a``.
_DRAWN = re.compile(r"LATIN (?:SMALL LETTER (?:SCRIPT )?|LETTER SMALL CAPITAL )([A-Z]|ALPHA)$")
#: Invisible characters that are not in the category of format characters, and visible ones that are.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0" + "".join(map(chr, (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))))
_SIGNS = frozenset(map(chr, (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)))
#: Rows without any character outside this class hold nothing to rewrite (checked inside the JVM).
PLAIN_ONLY = r"^[\x00-\x7F\u00A1-\u00AC\u00AE-\u0131\u0134-\u0148\u014A-\u017E\u2010-\u2027\u2030-\u205E\u2070-\u20FF\u2150-\u218F]*+$"
#: All code points but surrogates, Hangul syllables, unified ideographs, and planes that hold nothing else.
_LISTED = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0xE0000, 0xE0200))


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def script(letter: str) -> str:
    """First word of a letter's name: LATIN, GREEK, CYRILLIC, ... ; empty for what is no letter."""
    if letter < "\x80":
        return "LATIN" if letter.isalpha() else ""
    return unicodedata.name(letter, "").split(" ", 1)[0] if letter.isalpha() else ""


def stands_for(c: str) -> str | None:
    """The plain string for which a code point stands whatever is around it; None if it is plain itself."""
    kind = unicodedata.category(c)
    if c in INVISIBLE or (kind == "Cf" and c not in _SIGNS):
        return ""
    if kind == "Zs":
        return None if c == " " else " "
    tag, _, code = unicodedata.decomposition(c).partition("> ")
    if not tag:
        return None
    if tag in ("<wide", "<narrow"):
        return chr(int(code, 16))
    if tag == "<compat" and kind[0] == "L":
        parts = "".join(chr(int(x, 16)) for x in code.split())
        if len(parts) > 1 and parts.isalpha():
            return unicodedata.normalize("NFC", parts)
    composed = unicodedata.normalize("NFC", c)
    return composed if len(composed) == 1 and composed != c and kind[0] == "L" else None


def styled(c: str) -> str | None:
    """The letter of which a code point is a style (bold, script, long); None if it is none. The sign of micro is a sign."""
    tag, _, code = unicodedata.decomposition(c).partition("> ")
    if tag in ("<font", "<compat") and unicodedata.category(c)[0] == "L" and " " not in code and c != "µ":
        return chr(int(code, 16))
    return None


#: How the members of an edge go together: the first always gives way, gives way within words, the rarer gives way, or only where scripts mix.
ALWAYS, STYLE, RARER, SCRIPT = "always", "style", "rarer", "script"


def edges() -> Iterator[tuple[str, str, str]]:
    """(member, member, how) from the decompositions and names of the code points, and from letters drawn alike across scripts."""
    for n in (n for part in _LISTED for n in part):
        c = chr(n)
        plain = stands_for(c)
        if plain is not None:
            yield c, plain, ALWAYS
            continue
        apart = unicodedata.normalize("NFD", c) if unicodedata.decomposition(c) else ""
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == c:
            yield apart, c, ALWAYS
            # marks that were added one after the other
            yield from ((unicodedata.normalize("NFC", apart[:k]) + apart[k:], c, ALWAYS) for k in range(2, len(apart)))
        letter = styled(c)
        if letter is not None:
            yield c, letter, STYLE
        drawn = _DRAWN.match(unicodedata.name(c, ""))
        if drawn and c > "\x7f":
            yield c, drawn[1][0].lower(), RARER
    yield from ((o, latin, SCRIPT) for latin, others in SCRIPT_LOOKALIKES.items() for o in others)


class Rewriter:
    """Classes, representatives and the automaton, built from the corpus counts of code points."""

    def __init__(self, counts: dict[str, int]) -> None:
        classes, yielding, rarer = Classes(), set(), Classes()
        self.style: dict[str, str] = {}
        for a, b, how in edges():
            if not a:
                continue
            classes.join(a, b)
            if how == ALWAYS:
                yielding.add(a)
            elif how == STYLE:
                self.style[a] = b
            elif how == RARER:
                rarer.join(a, b)
        self.always: dict[str, str] = {}
        self.by_script: dict[str, dict[str, str]] = {}
        often = lambda x: (-counts.get(x, 0), x)
        for group in rarer.groups():  # letters of one script: the most frequent one stands for all
            best = min(group, key=often)
            self.always.update((x, best) for x in group if x != best)
        for group in classes.groups():
            plain = sorted((x for x in group if x not in yielding and x not in self.style and x not in self.always), key=often)
            best = {}
            for x in plain:
                best.setdefault(script(x) if len(x) == 1 else "", x)
            for x in group:
                if x in yielding:
                    self.always[x] = self._own(x, plain, best)
                elif len(x) == 1 and len(best) > 1 and x not in self.always and x not in self.style:
                    self.by_script[x] = best
        self.step = self._automaton()

    def __getstate__(self) -> dict:
        return {"always": self.always, "by_script": self.by_script, "style": self.style}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.step = self._automaton()

    @staticmethod
    def _own(x: str, plain: list[str], best: dict[str, str]) -> str:
        """Of the plain members, the one that the yielding string stands for in its own script."""
        direct = stands_for(x) if len(x) == 1 else unicodedata.normalize("NFC", x)
        if direct is not None and direct in plain:
            return best.get(script(direct) if len(direct) == 1 else "", direct)
        return direct if direct is not None else plain[0]

    def odd(self, text: Column) -> Column:
        """Whether a text may hold something to rewrite: an uncommon character, or a plain one that gives way to a more frequent one."""
        plain = "".join(sorted(x for x in self.always if len(x) == 1 and re.match(PLAIN_ONLY.replace("*+", "*"), x)))
        uncommon = ~text.rlike(PLAIN_ONLY)
        return uncommon | text.rlike(f"[{re.escape(plain)}]") if plain else uncommon

    def _automaton(self):
        try:
            import ahocorasick
        except ImportError:
            both = re.compile("|".join(re.escape(x) for x in sorted(self.always, key=len, reverse=True)))
            return lambda text: both.sub(lambda m: self.always[m[0]], text)
        machine = ahocorasick.Automaton()
        for x, y in self.always.items():
            machine.add_word(x, (len(x), y))
        machine.make_automaton()

        def step(text: str) -> str:
            out, at = [], 0
            for end, (n, y) in machine.iter_long(text):
                start = end + 1 - n
                out.append(text[at:start])
                out.append(y)
                at = end + 1
            return "".join(out) + text[at:] if out else text

        return step

    def word(self, word: str, around: str) -> str:
        """A word of letters in one script; ``around`` is the script of most letters of the text."""
        scripts = {script(c) for c in word}
        if len(scripts) == 1:
            own = next(iter(scripts))
            if own == around or (len(word) == 1 and not word.isupper()) or not all(around in self.by_script.get(c, ()) for c in word):
                return word
            return "".join(self.by_script[c][around] for c in word)
        for to in sorted(scripts, key=lambda s: (s != around, -sum(script(c) == s for c in word), s)):
            if all(script(c) == to or to in self.by_script.get(c, ()) for c in word):
                return "".join(c if script(c) == to else self.by_script[c][to] for c in word)
        return word

    def __call__(self, text: str | None) -> str | None:
        if text is None or (text.isascii() and self.always.keys().isdisjoint(text)):
            return text
        while True:  # every round shortens the text or leaves fewer characters that give way
            new = self.step(text)
            if not self.style.keys().isdisjoint(new):
                new = WORDS.sub(lambda m: "".join(self.style.get(c, c) for c in m[0]) if len(m[0]) > 1 else m[0], new)
            if new == text:
                break
            text = new
        words = WORDS.findall(text)
        used = [script(c) for w in words for c in w]
        if len(set(used)) < 2:
            return text
        around = max(sorted(set(used)), key=used.count)
        changed = {w: x for w in set(words) if not w.isascii() and (x := self.word(w, around)) != w}
        return WORDS.sub(lambda m: changed.get(m[0], m[0]), text) if changed else text


WORDS = re.compile(r"[^\W\d_]+")


def count_characters(column: DataFrame) -> dict[str, int]:
    """Corpus count of every code point of a one-column table.

    What reaches the driver is bounded by the number of code points, whatever
    the number of rows.
    """

    def counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        total: Counter[str] = Counter()
        for b in batches:
            total.update("".join(x for x in b["text"] if x is not None))
        yield pd.DataFrame({"code": [ord(c) for c in total], "n": list(total.values())}, columns=["code", "n"])

    found = column.toDF("text").mapInPandas(counts, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {chr(r["code"]): r["n"] for r in found.collect()}


def consistent(rows: DataFrame, key: list[str], text: str, counts: dict[str, int]) -> DataFrame:
    """(key, before, after) of the rows whose text is not already in its consistent form.

    Rows of plain characters are told apart inside the JVM and never reach Python.
    """
    r = Rewriter(counts)  # the classes are found here; tasks only build the automaton

    @F.pandas_udf("string")
    def rewrite(s: pd.Series) -> pd.Series:
        return s.map(r, na_action="ignore")

    odd = rows.select(*key, F.col(text).alias("before")).filter(r.odd(F.col("before")))
    return odd.withColumn("after", rewrite("before")).filter("after <> before")


def all_consistent(rows: DataFrame, text: str, counts: dict[str, int]) -> DataFrame:
    """The rows with ``text`` in its consistent form."""
    r = Rewriter(counts)  # the classes are found here; tasks only build the automaton

    @F.pandas_udf("string")
    def rewrite(s: pd.Series) -> pd.Series:
        return s.map(r, na_action="ignore")

    odd = rows.filter(r.odd(F.col(text))).withColumn(text, rewrite(F.col(text)))
    return rows.filter(F.col(text).isNull() | ~r.odd(F.col(text))).unionByName(odd)
