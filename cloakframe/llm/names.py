"""Problem 3: variant spellings of names.

Names are folded to Latin tokens, each distinct spelling of a class once; equal
foldings need no comparison. The others meet in a prefix-filtered join of one
class: a token is indexed under its rarest q-grams, as many as one edit can
spoil and one more. A link needs at least one pair of tokens that is equal or
within one edit (two abbreviations are never enough), so the index reaches
every pair that can verify. Pairs are
verified by soft weighted token similarity, in which tokens of rare q-grams
count more. Full spellings that are similar, and each one with initials with its
best partner, are edges; what hangs together is one person. Mentions of staff
meet the surnames of their school in the same index.

Defined results: null or letterless names link to nothing; repeated deliveries
count once; two records of one class and term are never one pupil; equal strings
give no row; a name of one token is linked to none of several; of equal scores
an initial goes to the fuller, then more frequent, then alphabetically last
spelling; a mention that fits several members of staff equally well names all.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import lookalike

Q = 2
#: Least soft similarity of two spellings.
SIMILAR = 0.7
#: One slip of a name is typed at most once for so many times the name. A token more frequent than any slip of the most frequent
#: one, and seen so many times, is a name of its own and no slip of another.
PER_SLIP, SEEN = 50, 5
#: Padded q-grams that one edit, a swap of neighbours included, can spoil; one more is the prefix.
SPOILT = Q + 1

#: Short forms of first names, each after the full ones.
SHORT_FORMS = {
    "adaeze": "ada", "alexander": "alex al sandy xander", "alexandra": "alex sandra lexi sasha", "anthony": "tony ant", "archibald": "archie archy", "arjun": "arj",
    "augustus": "gus augie", "ayesha": "esha aysh", "babatunde": "tunde baba", "bartholomew": "bart barty", "benjamin": "ben benny benji", "charlotte": "charlie lottie",
    "christina": "tina chris chrissy", "christopher": "chris kit topher", "chukwuemeka": "emeka chuks", "cordelia": "delia cordy", "cormac": "mac", "deepika": "deepa dee",
    "dominic": "dom nic", "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted teddy", "elizabeth": "liz lizzie beth betty eliza libby", "fionn": "finn",
    "florence": "flo florrie", "frances": "fran frankie francie", "frank": "frankie", "frederick": "fred freddie freddy", "gabrielle": "gabby gabi gaby elle", "gareth": "gaz gary",
    "grace": "gracie", "gregory": "greg", "harriet": "hattie harry", "ibrahim": "ibby ibra", "imogen": "immy imo", "ingrid": "inga", "isabella": "bella izzy",
    "jacqueline": "jackie jacqui", "jonathan": "jon jonny johnny", "jose": "pepe", "josephine": "jo josie josy", "joshua": "josh", "katherine": "kate katie kathy kat kit",
    "kwabena": "kobby kobi", "krzysztof": "krzys chris", "leonard": "len leo lenny", "lucia": "lucy luce", "lukasz": "luke", "malgorzata": "gosia gosha", "margaret": "maggie meg peggy margo madge",
    "marguerite": "margo daisy", "mark": "marky", "maryam": "mary mari", "matthew": "matt matty", "maximilian": "max", "michael": "mike mick", "miles": "milo", "mohammed": "mo moh",
    "nathaniel": "nat nate nathan", "niamh": "neevie", "nicholas": "nick nicky", "olivia": "liv livvy", "ottilie": "tilly ottie", "patrick": "pat paddy", "penelope": "penny nell",
    "philippa": "pip pippa", "rajesh": "raj", "rebecca": "becky bex becca", "reginald": "reg reggie", "robert": "rob bob bobby robbie", "rosalind": "ros roz lindy", "rose": "rosie",
    "samantha": "sam sammy", "samuel": "sam", "saoirse": "sersh", "sebastian": "seb bas", "stephen": "steve stevie ste", "sunita": "sunny", "susannah": "sue susie suzie zanna", "temitope": "temi tope",
    "theodora": "thea dora theo", "theodore": "theo ted teddy", "thomas": "tom tommy", "tomas": "tom", "victoria": "vicky tori vic", "vikram": "vik vicky", "william": "will bill billy liam willy",
    "winifred": "winnie freda", "yusuf": "yus joe", "zachary": "zach zac zack", "zuzanna": "zuza zuzia suzie",
}
_FULL: dict[str, list[str]] = {}
for _full, _shorts in SHORT_FORMS.items():
    for _s in _shorts.split():
        _FULL.setdefault(_s, []).append(_full)
_SHORT = {(full, s) for full, shorts in SHORT_FORMS.items() for s in shorts.split()}
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхцчшщъыьэюяжђћљњџјіїєґ", "a b v g d e z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya zh dj c lj nj dz j i yi ye g".split(), strict=True))
_SERBIAN = {"ц": "c", "х": "h"}
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True))
_SPECIAL = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"}
_LETTERS = {k: v.replace("_", "") for k, v in (_CYRILLIC | _GREEK | _SPECIAL).items()}
#: Accented letters of Latin-1 and Latin Extended-A whose folding is one letter, by rule.
_ACCENTED = {c: p for n in range(0xC0, 0x180) for c in [chr(n).lower()] if len(c) == 1 and len(p := _LETTERS.get(c, unicodedata.normalize("NFKD", c)[:1])) == 1 and p.isascii()}


def fold(name: str) -> str:
    """Lower-case Latin tokens in typed order, a surname before a comma moved to the end."""
    head, comma, tail = name.partition(",")
    if comma and head.strip() and tail.strip():
        name = f"{tail} {head}"
    name = unicodedata.normalize("NFC", name.lower())
    letters = _LETTERS | _SERBIAN if any(c in "ђћљњџј" for c in name) else _LETTERS
    plain = []
    before = ""
    for whole in name:
        for c in whole if whole in letters else unicodedata.normalize("NFKD", whole):
            if unicodedata.combining(c):
                continue
            plain.append("u" if c == "υ" and before == "ο" else letters.get(c, c))
            before = c
    return " ".join(re.findall(r"[^\W\d_]+", re.sub(r"['’`´\-]", "", "".join(plain))))


#: ASCII and accented Latin letters: such names are folded inside the JVM. Letters that fall apart into several are left out.
PLAIN_NAME = r"^[\x00-\x7F\u00C0-\u00C5\u00C7-\u00DD\u00E0-\u00E5\u00E7-\u00FD\u00FF-\u012F\u0131\u0134-\u013E\u0141-\u0148\u014A-\u0151\u0154-\u017E’]*+$"


def quick_folding(rows: DataFrame, name: str) -> DataFrame:
    """The rows with ``folding``, null where odd characters need Python, and then the name in ``_odd``.

    The steps are columns of their own, so that each is evaluated once.
    """
    n = F.col(name)
    turned = F.when(n.contains(","), F.regexp_replace(n, r"^\s*([^,]*[^,\s])\s*,\s*([^\s].*)$", "$2 $1")).otherwise(n)
    low = F.lower(turned)
    low = F.trim(F.translate(low, "".join(_ACCENTED) + "._'’`´-", "".join(_ACCENTED.values()) + "  "))
    steps = rows.withColumn("_plain", (F.octet_length(n) == F.length(n)) | n.rlike(PLAIN_NAME)).withColumn("_low", F.when(F.col("_plain"), low))
    folding = F.when(F.col("_low").rlike(r"^\p{L}++ \p{L}++$"), F.col("_low")).otherwise(F.trim(F.regexp_replace("_low", r"[^\p{L}]+", " ")))
    return steps.withColumns({"folding": folding, "_odd": F.when(~F.col("_plain"), n)}).drop("_plain", "_low")


def slow_folding(name: str) -> Column:
    """The folding of any name, in Arrow batches."""
    form = lookalike.Rewriter({})

    @F.pandas_udf("string")
    def slow(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fold(form(x)), na_action="ignore")

    return slow(F.col(name))


def folded(rows: DataFrame, name: str, settled: str, keep: bool = True, form: Callable[[Column], Column] = lambda c: c, id_of: str | None = None) -> DataFrame:
    """The rows with ``folding``, the folded tokens of ``name`` with spaces between and put into a form, and ``name`` itself if it is to be kept.

    With ``id_of``, ``id`` is the hash of that column and the folding.

    One pass folds what the JVM can and is written once; only the names left
    over, those with odd characters, are then sent to Python.
    """
    from cloakframe.sources.tables import settle

    done = lambda df: df.withColumn("folding", form(F.col("folding"))).withColumns({"id": F.xxhash64(id_of, "folding")} if id_of else {})
    quick = done(quick_folding(rows, name))
    once = settle(quick if keep else quick.drop(name), settled)
    odd = settle(done(once.filter("_odd IS NOT NULL").withColumn("folding", slow_folding("_odd"))).select(*once.columns), f"{settled}-odd")
    return once.filter("_odd IS NULL AND folding IS NOT NULL").unionByName(odd).drop("_odd")


def sorted_pair(folding: Column) -> Column:
    """A folding of two tokens in order of the alphabet, any other as it is."""
    a, b = F.substring_index(folding, " ", 1), F.substring_index(folding, " ", -1)
    return F.when((F.length(a) + F.length(b) + 1 == F.length(folding)) & (a > b), F.concat_ws(" ", b, a)).otherwise(folding)


def osa(a: str, b: str, most: int) -> int:
    """Edits between two tokens, a swap of neighbours counting one; ``most + 1`` if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    two, one, row = None, list(range(len(b) + 1)), None
    for x in range(1, len(a) + 1):
        row = [x] + [0] * len(b)
        for y in range(1, len(b) + 1):
            row[y] = min(one[y] + 1, row[y - 1] + 1, one[y - 1] + (a[x - 1] != b[y - 1]))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                row[y] = min(row[y], two[y - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def form_of(a: str, b: str) -> float:
    """How well the shorter token ``a`` stands for ``b`` as a short form, beginning or half of it; 0 if it is none."""
    if (b, a) in _SHORT or (a, b) in _SHORT:
        return 0.9
    if 2 <= len(a) <= 4 and b.startswith(a) and len(b) - len(a) >= 2:
        return 0.85
    if len(a) >= 4 and len(b) - len(a) >= 4 and len(b) >= 9 and (b.startswith(a) or b.endswith(a)):
        return 0.85  # half of a double-barrelled name
    return 0.0


def token_similarity(a: str, b: str) -> tuple[float, int]:
    """1 for equal tokens, less for short forms, initials and slips, 0 for different names; and the edits of a slip."""
    if a == b:
        return 1.0, 0
    if len(a) > len(b) or (len(a) == len(b) and a > b):
        a, b = b, a
    if len(a) == 1:
        return (0.8 if b[0] == a else 0.0), 0
    form = form_of(a, b)
    if form:
        return form, 0
    most = 1 if len(b) < 6 else 2
    edits = osa(a, b, most)
    if edits <= most and len(b) >= 3:
        return 1 - 0.7 * edits / len(b), edits
    return 0.0, 0


class Likeness:
    """Soft weighted similarity of names; remembers the tokens it met."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.light = weights, min(weights.values(), default=1.0)
        self.known: dict[str, float] = {}
        self.met: dict[tuple[str, str], tuple[float, int]] = {}

    def weight(self, token: str) -> float:
        """A token weighs as much as its rarest q-gram, an initial little."""
        if token not in self.known:
            self.known[token] = self.light if len(token) == 1 else max(self.weights.get(g, self.light) for g in grams(token))
        return self.known[token]

    def tokens(self, x: str, y: str, own: Collection[str] = ()) -> tuple[float, bool]:
        """Similarity of two tokens, and whether it is strong: equal or within one edit.

        Two names of their own are no slips of one another.
        """
        if x == y:
            return 1.0, len(x) > 2
        known = self.met.get((x, y))
        if known is None:
            known = self.met[x, y] = token_similarity(x, y)
        s, edits = known
        if edits and x in own and y in own:
            return 0.0, False
        return s, edits == 1

    def two(self, a: str, b: str, x: str, y: str, own: Collection[str]) -> float:
        """Similarity of two names of two tokens, in this order."""
        s, sure = self.tokens(a, x, own)
        if s <= 0:
            return 0.0
        t, also = self.tokens(b, y, own)
        if t <= 0 or not (sure or also):
            return 0.0
        v, w = max(self.weight(a), self.weight(x)), max(self.weight(b), self.weight(y))
        return (s * v + t * w) / (v + w)

    def __call__(self, a: list[str], b: list[str], own: Collection[str] = ()) -> float:
        """Similarity of two names; 0 if a first or last token has no counterpart or no pair of tokens is strong.

        Middle tokens may be missing from the other name. ``own`` has the tokens that are names of their own.
        """
        if len(a) < len(b):
            a, b = b, a
        if len(b) < 2:
            return 0.0 if a != b else 1.0
        best = 0.0
        if len(a) > len(b):
            if len(a) == 3:  # a double-barrelled surname written apart, or joined
                best = max(self([a[0], a[1] + a[2]], b, own), self([a[0] + a[1], a[2]], b, own))
            a = [a[0], *a[len(a) - len(b) + 1 :]]
        if len(a) == 2:
            return max(best, self.two(a[0], a[1], b[0], b[1], own), self.two(a[0], a[1], b[1], b[0], own))
        sims = [self.tokens(x, y, own) for x, y in zip(a, b, strict=True)]
        if min(s for s, _ in sims) > 0 and any(strong for _, strong in sims):
            ws = [max(self.weight(x), self.weight(y)) for x, y in zip(a, b, strict=True)]
            best = max(best, sum(s * w for (s, _), w in zip(sims, ws, strict=True)) / sum(ws))
        return best


def grams(token: str) -> set[str]:
    t = re.sub(r"[^a-z]", "?", token)
    t = f"^{t}$"
    return {t[i : i + Q] for i in range(max(1, len(t) - Q + 1))}


def gram_weights(names: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every q-gram; letters outside a to z count as one, so there are at most 29 ** Q."""
    t = F.concat(F.lit("^"), F.regexp_replace("t", "[^a-z]", "?"), F.lit("$"))
    cut = names.select(t.alias("t")).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - Q + 1, F.lit(1))), lambda i: F.substring("t", i, F.lit(Q)))).alias("g"))
    counts = {r["g"]: r["n"] for r in cut.groupBy("g").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(counts.values()))
    return {g: math.log(1 + total / n) for g, n in counts.items()}


def features(token: str, weights: dict[str, float]) -> list[str]:
    """The q-grams under which a token is indexed, the rarest first.

    An edit spoils at most SPOILT padded q-grams. Of two tokens within one edit,
    take the q-grams that are first in one order of rarity: among SPOILT + 1 of
    each, one at least is common to both, unless a token has fewer, which then
    are all taken.
    """
    if len(token) < 2:
        return []
    return sorted(grams(token), key=lambda g: (-weights.get(g, math.inf), g))[: SPOILT + 1]


def cutter(weights: dict[str, float]) -> Callable[[Column], Column]:
    """The features of each token of an array, in Arrow batches."""

    @F.pandas_udf("array<array<string>>")
    def cut(s: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}

        def own(tokens) -> list[list[str]]:
            for t in tokens:
                if t not in known:
                    known[t] = features(t, weights)
            return [known[t] for t in tokens]

        return s.map(own, na_action="ignore")

    return cut


def indexed(rows: DataFrame, tokens: str, cut: str, within: str) -> DataFrame:
    """One row per token and feature: ``t``, ``_f``, the hash of the feature and of the column ``within``, and ``_top``, whether it is the token's first."""
    each = rows.select("*", F.posexplode(tokens).alias("_i", "t")).withColumn("_g", F.element_at(cut, F.col("_i") + 1))
    out = each.select("*", F.posexplode("_g").alias("_at", "_x"))
    return out.withColumns({"_f": F.xxhash64(within, "_x"), "_top": F.col("_at") == 0}).drop(tokens, cut, "_i", "_g", "_at", "_x")


def meeting(x: str, y: str) -> Column:
    """Whether the entries ``a`` and ``b`` of one feature make a candidate: equal tokens meet once, under their first feature."""
    return (F.col("a._f") == F.col("b._f")) & ((F.col("a._top") & F.col("b._top")) | (F.col(f"a.{x}") != F.col(f"b.{y}")))


def tasks(df: DataFrame) -> int:
    """Tasks of a stage in which Python compares names: as many as a shuffle has, however little data there is."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


TITLES = ("mr", "mrs", "ms", "miss", "dr")


def _steady(value: str, classes: tuple[tuple[str, ...], ...]) -> Column:
    """A bit for the class of a value, 0 where it is unknown."""
    known = F.create_map(*(F.lit(x) for i, words in enumerate(classes) for w in words for x in (w, 1 << i)))
    return F.coalesce(known[F.lower(F.trim(F.translate(value, "().", "")))], F.lit(0))


#: Terms that one mask holds.
BITS = 62


class Spellings:
    """The distinct names of each class, folded, and its distinct spellings.

    ``names``: one row per class and name with the hashes of both (``nm``) and of
    class and key (``id``). ``keys``: one row per class and key with what its
    records have in common. A key is the tokens in order of the alphabet if
    there are two, in typed order otherwise. The list of terms (of a school
    system, some dozens) is read to the driver to give each term its bit;
    ``masks`` are as many columns as the terms need. ``counts``: how often each
    token occurs, all tokens. ``own``: those that are names of their own.
    """

    def __init__(self, table: DataFrame) -> None:
        from cloakframe.sources.tables import settle

        rows = table.select("class_id", "record_id", "term", "pupil_name", "gender", "pp", "eal").filter("class_id IS NOT NULL AND pupil_name IS NOT NULL AND record_id IS NOT NULL")
        terms = sorted(r["term"] for r in rows.filter("term IS NOT NULL").select("term").distinct().collect())
        self.masks = [f"m{i}" for i in range(max(1, math.ceil(len(terms) / BITS)))]

        def bit(part: list[str]) -> Column:
            known = F.create_map(*(F.lit(x) for i, t in enumerate(part) for x in (t, 1 << i))) if part else None
            return (F.coalesce(known[F.col("term")], F.lit(0)) if part else F.lit(0)).cast("long")

        yes_no = (("yes", "y"), ("no", "n"))
        bits = [bit(terms[i * BITS : (i + 1) * BITS]).alias(m) for i, m in enumerate(self.masks)]
        nm = F.xxhash64("class_id", "pupil_name").alias("nm")
        self.records = rows.select(nm, "record_id", *bits)
        # what is known of sex, pp and eal: two bits each
        steady = _steady("gender", (("m", "male"), ("f", "female"))) + 4 * _steady("pp", yes_no) + 16 * _steady("eal", yes_no)
        common = [F.bit_or(c).alias(c) for c in (*self.masks, "steady")]
        distinct = rows.select("class_id", "pupil_name", *bits, steady.alias("steady")).groupBy("class_id", "pupil_name").agg(*common, F.count("*").alias("n"))
        self.names = folded(distinct.select("*", nm), "pupil_name", "names", keep=False, form=sorted_pair, id_of="class_id").withColumnRenamed("folding", "key").filter("key <> ''")
        self.keys = settle(self.names.groupBy("class_id", "key").agg(*common, F.sum("n").alias("n"), (F.count("*") > 1).alias("several")).withColumn("id", F.xxhash64("class_id", "key")), "spellings")
        counts = settle(self.keys.select(F.explode(F.split("key", " ")).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("seen")), "tokens")
        most = counts.agg(F.max("seen")).first()[0] or 0
        self.own = settle(counts.filter(F.col("seen") >= max(SEEN, most / PER_SLIP)).select("t"), "own")
        self.counts = counts


def linked_spellings(names: Spellings) -> DataFrame:
    """(id, person): the person that each linked spelling means.

    A spelling found in every term of its class cannot belong to another, since
    a class lists each pupil once a term; it takes no part.
    """
    from cloakframe.sources.tables import settle

    masks = names.masks
    whole = names.keys.groupBy("class_id").agg(*(F.bit_or(m).alias(f"all_{m}") for m in masks))
    missing = " OR ".join(f"{m} <> all_{m}" for m in masks)
    own = lambda c, to: names.own.select(F.col("t").alias(c), F.lit(True).alias(to))
    open_ = names.keys.join(whole, "class_id").filter(missing).select("id", "class_id", "key", *masks, "steady", "n", F.substring_index("key", " ", 1).alias("first"), F.substring_index("key", " ", -1).alias("last"))
    weights = gram_weights(names.counts.select("t"))
    cut, tokens = cutter(weights), F.array_distinct(F.concat(F.split("key", " "), halves_joined("key")))
    open_ = settle(open_.join(own("first", "own_first"), "first", "left").join(own("last", "own_last"), "last", "left").fillna(False, ["own_first", "own_last"]).drop("first", "last").withColumn("tokens", tokens).withColumn("cut", cut("tokens")), "open")
    entries = indexed(open_.select("id", "class_id", *masks, "steady", "tokens", "cut"), "tokens", "cut", "class_id").select("_f", "_top", F.xxhash64("t").alias("h"), "id", *masks, "steady")
    a, b = entries.alias("a"), entries.alias("b")
    may = (F.col("a.id") < F.col("b.id")) & meeting("h", "h")
    for m in masks:
        may = may & (F.col(f"a.{m}").bitwiseAND(F.col(f"b.{m}")) == 0)
    for two in (3, 12, 48):  # what is known of both must not differ, unless one of them holds both values
        x, y = F.col("a.steady").bitwiseAND(two), F.col("b.steady").bitwiseAND(two)
        may = may & ((x == 0) | (y == 0) | (x.bitwiseAND(y) != 0))
    met = a.join(b, may).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        likeness = Likeness(weights)
        for kx, ky, ax, zx, ay, zy in batches:
            out = []
            for p, q, *own in zip(*(z.tolist() for z in (kx, ky, ax, zx, ay, zy)), strict=True):
                c, d = p.split(" "), q.split(" ")
                out.append(likeness(c, d, [t for t, yes in zip((c[0], c[-1], d[0], d[-1]), own) if yes]))
            yield pd.Series(out, dtype="float64")

    side = lambda e: open_.select(F.col("id").alias(e), F.col("key").alias(f"k{e}"), F.col("n").alias(f"n{e}"), F.col("own_first").alias(f"a{e}"), F.col("own_last").alias(f"z{e}"))
    pairs = met.join(side("x"), "x").repartition(tasks(met), "y").join(side("y"), "y")
    full = lambda k: F.least(F.size(F.filter(F.split(k, " "), lambda x: F.length(x) > 1)), F.lit(2))
    scored = settle(
        pairs.withColumn("score", F.round(alike("kx", "ky", "ax", "zx", "ay", "zy"), 6)).filter(F.col("score") >= SIMILAR)
        .select("x", "y", "score", full("kx").alias("fx"), full("ky").alias("fy"), "nx", "ny", "kx", "ky"), "pairs",
    )

    def one(a: str, b: str) -> DataFrame:
        rank = F.struct("score", F.col(f"f{b}").alias("f"), F.col(f"n{b}").alias("n"), F.col(f"k{b}").alias("k"))
        return scored.filter(f"f{a} < 2").select(F.col(a).alias("x"), rank.alias("r"), F.col(b).alias("y"))

    # an initial may fit several pupils: only its best partner counts
    part = one("x", "y").unionByName(one("y", "x")).groupBy("x").agg(F.max_by("y", "r").alias("y"))
    return components(scored.filter("fx = 2 AND fy = 2").select("x", "y").unionByName(part))


def halves_joined(key: str) -> Column:
    """The tokens of a name of three with two neighbours written as one."""
    t = F.split(key, " ")
    return F.when(F.size(t) == 3, F.array(F.concat(t[0], t[1]), F.concat(t[1], t[2]))).otherwise(F.array().cast("array<string>"))


def components(edges: DataFrame) -> DataFrame:
    """(id, person): the smallest id that each id of the edges (x, y) can reach.

    Labels spread along the edges until none changes; every round is written
    to the shared folder, and nothing but a count reaches the driver.
    """
    from cloakframe.sources.tables import settle

    both = settle(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("id")).alias("person")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "person"), "y").select(F.col("x").alias("id"), "person", F.lit(None).cast("long").alias("own"))
        said = near.unionByName(labels.select("id", "person", F.col("person").alias("own")))
        new = settle(said.groupBy("id").agg(F.min("person").alias("person"), F.min("own").alias("own")).select("id", "person", (F.col("person") < F.col("own")).alias("moved")), "labels")
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels


def same_pupils(names: Spellings) -> DataFrame:
    """(left_id, right_id): records of one class that mean one pupil under unequal spellings."""
    who = linked_spellings(names)
    # spellings that are alone and always typed alike have no pair and stay out
    person = names.keys.select("id", "several").join(who, "id", "left").filter("several OR person IS NOT NULL").select("id", F.coalesce("person", "id").alias("person"))
    some = names.names.select("id", "nm").join(person, "id").select("nm", "person")
    # repeated deliveries count once; the partitioning by person serves the join as well
    some = names.records.join(some, "nm").repartition("person").groupBy("person", "record_id").agg(F.min("nm").alias("nm"), *(F.bit_or(m).alias(m) for m in names.masks))
    a, b = some.alias("a"), some.alias("b")
    may = (F.col("a.person") == F.col("b.person")) & (F.col("a.record_id") < F.col("b.record_id")) & (F.col("a.nm") != F.col("b.nm"))
    for m in names.masks:
        may = may & (F.col(f"a.{m}").bitwiseAND(F.col(f"b.{m}")) == 0)
    return a.join(b, may).select(F.col("a.record_id").alias("left_id"), F.col("b.record_id").alias("right_id"))


TITLE = r"(?:[Mm][Rr][Ss]?|[Mm][Ss]|[Mm][Ii][Ss][Ss]|[Dd][Rr])\b"
_WORD = r"[\p{L}\p{M}'’\-\u00AD\u200B-\u200F\u2060\uFEFF]++"
_CAPITAL = r"(?:\p{Lu}|(?:bin|de|al|el|le|van|von)-\p{Lu})"
#: Not inside a word; a full stop after an initial.
_START = r"(?<![\p{L}\p{M}\p{Nd}_])(?=\p{Lu}|m[RrIiSs]|d[Rr]|(?:bin|de|al|el|le|van|von)-)(?<![\p{L}\p{M}]['’\-\u00AD\u200B-\u200F\u2060\uFEFF])"
_STOP = r"(?:(?<=(?<![\p{L}\p{M}'’\-])\p{L}\p{M}{0,2})\.)?"
#: A title and up to three words, or two or three capitalised words of which the first follows no title. Every title and capitalised
#: word begins one, so that no name is lost to the words before it.
_NEXT = rf"(?={_CAPITAL})(?!{TITLE}){_WORD}"
MENTION = (
    rf"{_START}(?=({TITLE}\.?[ \u00A0]++{_WORD}(?:{_STOP}[ \u00A0](?!{TITLE}){_WORD}(?:{_STOP}[ \u00A0]{_NEXT})?)?"
    rf"|(?={_CAPITAL})(?<!\b{TITLE}\.?[ \u00A0]{{1,4}}){_WORD}{_STOP},?[ \u00A0]{_NEXT}(?:{_STOP}[ \u00A0]{_NEXT})?))"
)


def mentions(records: DataFrame) -> DataFrame:
    """(record_id, school_id, said): what in a comment may name a person, with its title and words."""
    kept = records.filter("comments IS NOT NULL AND school_id IS NOT NULL AND record_id IS NOT NULL")
    return kept.select("record_id", "school_id", F.explode(F.regexp_extract_all("comments", F.lit(MENTION), F.lit(1))).alias("said")).withColumn(
        "said", F.regexp_replace("said", r"['’][sS](?![\p{L}\p{M}])", "")
    )


def staff_similarity(said: list[str], title: str, name: list[str], near: set[str], likeness: Likeness) -> float:
    """How well a folded mention names a member of staff, whose surname the words of ``near`` spell.

    With their title the surname alone may follow; otherwise both names must be
    there, in either order, and count by their weight.
    """
    first, last = name[0], name[-1]
    titled = said[0] in TITLES
    words, own_title = (said[1:], said[0] == title) if titled else (said, False)
    best = 0.0
    for j, w in enumerate(words):
        if w not in near:
            continue
        s = likeness.tokens(w, last)[0] or 0.85  # a part of a double-barrelled surname
        around = words[:j] if titled else [*words[:j], *words[j + 1 : j + 2]]
        given = max((likeness.tokens(x, first)[0] for x in around if not titled or own_title or len(x) > 2), default=0.0)
        if given > 0:
            wf, wl = likeness.weight(first), likeness.weight(last)
            best = max(best, (given * wf + s * wl) / (wf + wl))
        elif titled and j > 0 and s >= 0.9:
            return 0.0  # a known surname after another first name is somebody else's
        elif titled and j == 0 and own_title and (w != first or len(words) == 1):
            best = max(best, s)
    return best


def staff_named(records: DataFrame, staff: DataFrame, own: DataFrame) -> DataFrame:
    """(record_id, staff_id): comments that name a member of staff of the record's own school.

    Distinct words of a school's mentions meet its staff's surnames in the
    index; mentions with a word that spells a surname are compared as a whole.
    ``own`` has the tokens (t) that are names of their own: such a word is no
    slip of a surname.
    """
    from cloakframe.sources.tables import settle

    said = settle(mentions(records), "mentions")
    distinct = folded(said.select("school_id", "said").distinct(), "said", "said").withColumnRenamed("folding", "tokens")
    people = folded(staff.select("school_id", "staff_id", "title", "staff_name").filter("school_id IS NOT NULL AND staff_name IS NOT NULL"), "staff_name", "staff").filter("folding <> ''").select(
        "school_id", "staff_id", F.lower(F.regexp_replace("title", r"\W", "")).alias("title"), F.col("folding").alias("name"), F.substring_index("folding", " ", -1).alias("last"), "staff_name"
    )

    @F.pandas_udf("array<string>")
    def spoken(s: pd.Series) -> pd.Series:
        """The surname, and each part of a double-barrelled one."""

        def parts(name: str) -> list[str]:
            last = name.split()[-1]
            return [fold(p).replace(" ", "") for p in dict.fromkeys([last, *last.split("-")])]

        return s.map(parts)

    people = settle(people.filter(F.col("name").contains(" ")).withColumn("said_as", spoken("staff_name")).drop("staff_name"), "people")
    weights = gram_weights(people.select(F.explode(F.split("name", " ")).alias("t")))
    long = distinct.select("school_id", "said", "tokens", F.explode(F.array_distinct(F.split("tokens", " "))).alias("t")).filter((F.length("t") > 1) & ~F.col("t").isin(*TITLES))
    cut = cutter(weights)
    words = indexed(long.select("school_id", "t").distinct().select("school_id", F.array("t").alias("tokens")).withColumn("cut", cut("tokens")), "tokens", "cut", "school_id").alias("a")
    surnames = people.select("school_id", "last", F.filter("said_as", lambda t: F.length(t) > 2).alias("tokens")).distinct().withColumn("cut", cut("tokens"))
    surnames = indexed(surnames, "tokens", "cut", "school_id").alias("b")
    met = words.join(surnames, meeting("t", "t")).select("a.school_id", "a.t", F.col("b.t").alias("part"), "b.last").distinct()

    @F.pandas_udf("boolean")
    def spells(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        likeness = Likeness({})
        return pd.Series([likeness.tokens(x, y, (x, y) if own else ())[1] for x, y, own in zip(a, b, n, strict=True)], dtype="bool")

    sized = met.join(own.select("t", F.lit(True).alias("own")), "t", "left").fillna(False, ["own"])
    near = settle(sized.filter(spells("t", "part", "own")).select("school_id", "t", "last").distinct(), "near")

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        likeness = Likeness(weights)
        for a, t, n, w in batches:
            yield pd.Series([staff_similarity(x.split(" "), y or "", z.split(" "), set(v.split(" ")), likeness) for x, y, z, v in zip(a, t, n, w, strict=True)], dtype="float64")

    fits = long.join(near, ["school_id", "t"]).groupBy("school_id", "said", "tokens", "last").agg(F.array_join(F.collect_set("t"), " ").alias("near"))
    fits = fits.join(people, ["school_id", "last"]).withColumn("score", F.round(alike("tokens", "title", "name", "near"), 6)).filter(F.col("score") >= SIMILAR)
    named = settle(fits.select("school_id", "said", "staff_id", "score"), "named")
    best = named.join(named.groupBy("school_id", "said").agg(F.max("score").alias("score")), ["school_id", "said", "score"])
    return said.join(best, ["school_id", "said"]).select("record_id", "staff_id").distinct()
