"""Pseudonyms with ID tokens.

Two modes. ``exact`` draws names one after the other within a cohort, as a
seeded sequence prescribes, and shuffles its rows; a cohort is a class and is
handled in one task, and one that the name bank cannot serve is an error.
``scale`` numbers all rows and takes pair number ``a * ord + b`` of the first
names times surnames, which never repeats and needs no state; rows past the
number of pairs get a numeric suffix.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.prng import draw, draw_value, generator, permutation
from cloakframe.functions.text import normal_name_order, trimmed
from cloakframe.operators.order import numbered
from cloakframe.sources.lexicon import name_bank

MAPPING = "cohort string, ord long, id_token string, fake_name string, real_name string"


def name_parts(c: Column) -> Column:
    """The lower-case parts of a name, in normal order."""
    return F.filter(F.split(F.lower(trimmed(normal_name_order(c))), r"\s+"), lambda x: x != "")


def blocked_tokens(df: DataFrame, name: str, flags: DataFrame | None = None, staff: Sequence[str] = ()) -> DataFrame:
    """(token): parts of all names, values of flags (column value), and parts of staff names; none may become a pseudonym."""
    out = df.select(F.explode(name_parts(F.coalesce(F.col(name), F.lit("")))).alias("token"))
    if flags is not None:
        out = out.unionByName(flags.filter("value <> ''").select(F.lower("value").alias("token")))
    extra = sorted({p.lower() for s in staff for p in s.split()})
    if extra:
        out = out.unionByName(df.sparkSession.createDataFrame([(t,) for t in extra], "token string"))
    return out.distinct()


def id_token(n: Column) -> Column:
    return F.concat(F.lit("S"), F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))


def first_name_list(gender: Column, mode: str = "aware") -> Column:
    """Key of the list from which a first name comes; ``all`` is male, female and neutral one after the other."""
    if mode == "neutral":
        return F.lit("neutral")
    g = F.lower(trimmed(gender))
    return F.when(g.isin("m", "male"), "male").when(g.isin("f", "female"), "female").when(g.isin("x", "non-binary", "nonbinary", "other"), "neutral").otherwise("all")


class NamesExhausted(ValueError):
    """The bank has no name left that is neither blocked nor used."""


def pick(names: Sequence[str], taken: set[str], following) -> str:
    """A drawn name that is not taken: up to three draws per name of the list, then the first free one."""
    for _ in range(3 * len(names)):
        name = names[int(following() * len(names))]
        if name.lower() not in taken:
            return name
    for name in names:
        if name.lower() not in taken:
            return name
    raise NamesExhausted("every name of the bank is blocked or used")


def exact_cohort(names: Sequence[str], keys: Sequence[str], bank: Mapping[str, Sequence[str]], blocked: Iterable[str], seed: int) -> tuple[list[str], int]:
    """Pseudonyms of one cohort in row order, and how many draws they took."""
    following = generator(seed)
    lists = {**bank, "all": [*bank["male"], *bank["female"], *bank["neutral"]]}
    blocked = set(blocked)
    first, last, out = set(blocked), set(blocked), []
    for key in keys:
        a = pick(lists[key], first, following)
        first.add(a.lower())
        b = pick(bank["surnames"], last, following)
        last.add(b.lower())
        out.append(f"{a} {b}")
    return out, following.used


def exact(
    df: DataFrame, name: str, order: str, seed: int = 42, cohort: str | None = None, gender: str | None = None, mode: str = "aware",
    blocked: Iterable[str] = (), bank: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(cohort, ord, id_token, fake_name, real_name, draws) in the order of each cohort's rows.

    ``draws`` is the number used by the cohort, from where noise and shuffle go on.
    """
    bank = {k: list(v) for k, v in (bank or name_bank()).items()}
    blocked = frozenset(blocked)
    rows = df.select(
        (F.col(cohort).cast("string") if cohort else F.lit("")).alias("cohort"), F.col(order).alias("o"), normal_name_order(F.col(name)).alias("real_name"),
        first_name_list(F.col(gender) if gender else F.lit(None).cast("string"), mode).alias("key"),
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable").reset_index(drop=True)
        fakes, used = exact_cohort(pdf["real_name"].tolist(), pdf["key"].tolist(), bank, blocked, seed)
        n = range(1, len(pdf) + 1)
        return pd.DataFrame({
            "cohort": pdf["cohort"], "ord": list(n), "id_token": [f"S{i:02d}" for i in n], "fake_name": fakes, "real_name": pdf["real_name"], "draws": used,
        })

    return rows.groupBy("cohort").applyInPandas(one, MAPPING + ", draws int")


def exact_shuffle(n: int, seed: int, used: int) -> list[int]:
    """Fisher-Yates order of n rows, drawn after ``used`` draws."""
    return permutation(n, generator(seed, used))


def affine(pairs: int, seed: int) -> tuple[int, int]:
    """Multiplier and offset of a permutation of 0 .. pairs - 1."""
    if pairs < 1:
        raise NamesExhausted("every name of the bank is blocked")
    a = int(draw_value(seed, 1) * pairs) | 1
    while math.gcd(a, pairs) != 1:
        a += 2
    return a % pairs or 1, int(draw_value(seed, 2) * pairs)


def scale(df: DataFrame, name: str, order: list[str], seed: int = 42, blocked: DataFrame | None = None, bank: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The rows with ``ord``, ``id_token``, ``fake_name`` and ``real_name``, for tables of any size.

    The bank, a fixed list, loses its blocked names on the driver: only those
    of the bank's own names that are blocked are read.
    """
    bank = bank or name_bank()
    firsts, lasts = [*dict.fromkeys([*bank["male"], *bank["female"], *bank["neutral"]])], [*dict.fromkeys(bank["surnames"])]
    if blocked is not None:
        every = {x.lower() for x in (*firsts, *lasts)}
        gone = {r["token"] for r in blocked.filter(F.col("token").isin(*every)).select("token").distinct().collect()}
        firsts, lasts = [x for x in firsts if x.lower() not in gone], [x for x in lasts if x.lower() not in gone]
    pairs = len(firsts) * len(lasts)
    a, b = affine(pairs, seed)
    rows = numbered(df, order, "ord")
    at = F.pmod(F.col("ord") % pairs * a + b, F.lit(pairs))
    pick_of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    suffix = F.when(F.col("ord") > pairs, F.concat(F.lit(" "), F.floor((F.col("ord") - 1) / pairs + 1).cast("string"))).otherwise("")
    fake = F.concat(pick_of(firsts, F.floor(at / len(lasts))), F.lit(" "), pick_of(lasts, at % len(lasts)), suffix)
    return rows.withColumns({"id_token": id_token(F.col("ord")), "fake_name": fake, "real_name": normal_name_order(F.col(name))})


def shuffled(df: DataFrame, order: list[str], seed: int, used: int = 0) -> DataFrame:
    """The rows with ``position``, their place in a seeded permutation: sorted by one draw each, ties by row number."""
    return numbered(numbered(df, order, "_ord").withColumn("_u", draw(seed, F.col("_ord") + used)), ["_u", "_ord"], "position").drop("_u", "_ord")


def replaced(df: DataFrame, name: str) -> DataFrame:
    """The rows of scale() with the name cell as ``Fake Name [S01]`` and without the mapping's columns."""
    cell = F.concat("fake_name", F.lit(" ["), "id_token", F.lit("]"))
    return df.withColumn(name, cell).drop("id_token", "fake_name", "real_name")
