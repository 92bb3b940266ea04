"""What kind of column each heading and its cells look like (C1-C9, B5), in two aggregations over distinct cells."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.numeric import WHOLE
from cloakframe.functions.text import trimmed
from cloakframe.operators.columns import IDENTIFIER_HEADINGS, heading_matches

# Fixed values.
TYPES = ("name", "date", "numerical", "categorical", "free-text")
THRESHOLDS = {"name": 0.90, "free-text": 0.85, "date": 0.80, "numerical": 0.75, "categorical": 0.75}
MIS_WORDS = ("form", "house", "set", "ks2", "fft", "cat", "pp", "sen", "eal", "lac", "attendance", "teacher", "tutor", "year", "class")
BOOST_WORDS = {
    "name": ("name", "student", "pupil"),
    "numerical": ("score", "mark", "percent", "attendance", "grade"),
    "free-text": ("comment", "note", "remark"),
    "date": ("date", "dob", "birth"),
}
BOOST, MIS_BOOST = 0.10, 0.25
EXCEPTIONS = ("absent", "n/a", "x", "-", "")
DATE_SHAPES = (
    r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$",
    r"^\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}$",
    r"\b\d{1,2}[\s\-][A-Za-z]{3,9}[\s\-,]\s*\d{2,4}\b",
    r"\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}\b",
)


def _has_word(heading: str, words) -> bool:
    return any(re.search(rf"\b{w}\b", heading, re.I) for w in words)


def is_sensitive(heading: str) -> bool:
    return heading_matches(heading, IDENTIFIER_HEADINGS)


def sensitive(heading: Column) -> Column:
    """The same test on a column of headings."""
    return heading.rlike("(?i)" + "|".join(f"(?:{p})" for p in IDENTIFIER_HEADINGS))


def is_mis_categorical(heading: str) -> bool:
    return _has_word(heading, MIS_WORDS)


def boosted(heading: str, kind: str) -> bool:
    return _has_word(heading, BOOST_WORDS.get(kind, ()))


_WORD = r"[.'\-]*[A-Za-z](?:[A-Za-z'\-]*[A-Za-z])?[.'\-]*"


def looks_like_name(t: Column) -> Column:
    """Two to four words of letters, not all of them of one or two letters; ``t`` is trimmed."""
    plain = trimmed(F.translate(t, ",", ""))
    shape = plain.rlike(rf"^{_WORD}(?:\s+{_WORD}){{1,3}}$")
    long = F.regexp_replace(plain, r"[^A-Za-z\s]", "").rlike(r"[A-Za-z]{3}")
    return F.length(t).between(3, 50) & shape & long


def looks_like_exception(t: Column) -> Column:
    return F.lower(t).isin(*EXCEPTIONS)


def looks_like_number(t: Column) -> Column:
    return ~looks_like_exception(t) & (t.rlike(WHOLE) | t.rlike(r"^\d+(?:\.\d+)?%$"))


def looks_like_date(t: Column) -> Column:
    return t.rlike("|".join(f"(?:{p})" for p in DATE_SHAPES))


def column_scores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: cells, and the fraction that looks like each type, distinct share and mean length.

    Every distinct trimmed cell is looked at once and counts as often as it
    occurs; both aggregations combine before the shuffle.
    """
    columns = columns if columns is not None else df.columns
    long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("index"), trimmed(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("t")) for i, c in enumerate(columns)))).alias("x")).select("x.*")
    cells = long.filter("t <> ''").groupBy("index", "t").agg(F.count("*").alias("n"))
    share = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)) / F.sum("n")
    t = F.col("t")
    numbers = F.sum(F.when(looks_like_number(t), F.col("n")).otherwise(0))
    stats = cells.groupBy("index").agg(
        F.sum("n").alias("filled"), share(looks_like_name(t)).alias("name_share"), share(looks_like_date(t)).alias("date_share"),
        F.when(numbers > 0, (numbers + F.sum(F.when(looks_like_exception(t), F.col("n")).otherwise(0))) / F.sum("n")).otherwise(0.0).alias("number_share"),
        F.countDistinct(F.lower(t)).alias("distinct_cells"), (F.sum(F.length(t) * F.col("n")) / F.sum("n")).alias("mean_length"),
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "index int, name string")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("filled", "distinct_cells")]
    return names.join(stats, "index", "left").select(
        "index", "name", *zero, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("name_share", "date_share", "number_share", "mean_length"))
    )


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(index, name, type, confidence, sensitive, reviewRequired) of every column."""
    columns = columns if columns is not None else df.columns
    by = lambda test: F.col("index").isin(*([i for i, c in enumerate(columns) if test(c)] or [-1]))
    lift = lambda score, kind: F.when(by(lambda c: boosted(c, kind)), F.least(F.lit(1.0), score + BOOST)).otherwise(score)
    ratio, mean = F.col("distinct_cells") / F.col("filled"), F.col("mean_length")
    cat = F.when((ratio < 0.3) & (mean < 20), 1 - ratio).when((ratio < 0.5) & (mean < 20), 0.5).otherwise(0.0)
    cat = F.when(by(is_mis_categorical), F.least(F.lit(1.0), cat + MIS_BOOST)).otherwise(cat)
    free = F.when((mean > 30) & (ratio > 0.7), F.least(F.lit(1.0), ratio * F.when(mean > 50, 1.0).otherwise(0.9))).when((mean > 20) & (ratio > 0.5), 0.5).otherwise(0.0)
    score = {
        "name": lift(F.col("name_share"), "name"), "date": lift(F.col("date_share"), "date"), "numerical": lift(F.col("number_share"), "numerical"),
        "categorical": cat, "free-text": lift(free, "free-text"),
    }
    scored = column_scores(df, columns).select("*", *(F.when(F.col("filled") == 0, 0.0).otherwise(v).alias(f"s_{k}") for k, v in score.items()))
    s = {k: F.col(f"`s_{k}`") for k in TYPES}
    best = F.greatest(*s.values())
    chosen = F.coalesce(*(F.when(s[k] >= THRESHOLDS[k], F.lit(k)) for k in TYPES), F.when(best == 0, "categorical"), *(F.when(s[k] == best, F.lit(k)) for k in TYPES))
    typed = scored.withColumn("kind", chosen)
    value, need = F.lit(0.0), F.lit(0.75)
    for k in TYPES:
        value, need = F.when(F.col("kind") == k, s[k]).otherwise(value), F.when(F.col("kind") == k, THRESHOLDS[k]).otherwise(need)
    sensitive = by(is_sensitive)
    return typed.select(
        "index", "name", F.when(sensitive, "identifier").otherwise(F.col("kind")).alias("type"), (F.floor(value * 100 + 0.5) / 100).alias("confidence"),
        sensitive.alias("sensitive"), (~sensitive & (value < need)).alias("reviewRequired"),
    )


@dataclass(frozen=True)
class Roles:
    """Which columns play which part."""

    name: str
    gender: str | None
    numeric: tuple[str, ...]
    free_text: tuple[str, ...]
    categorical: tuple[str, ...]


def roles(df: DataFrame, name: str | None = None, gender: str | None = None, numeric: tuple[str, ...] | None = None) -> Roles:
    """Roles from the profile, which has one row per column; given columns win."""
    rows = sorted(profile(df).collect(), key=lambda r: r["index"])
    of = lambda kind: tuple(r["name"] for r in rows if r["type"] == kind)
    return Roles(
        name or next(iter(of("name")), df.columns[0]),
        gender or next((c for c in df.columns if re.search("gender", c, re.I)), None),
        tuple(numeric) if numeric is not None else of("numerical"),
        tuple(r["name"] for r in rows if r["type"] == "free-text" or re.search("comment|note|remark", r["name"], re.I)),
        of("categorical"),
    )


def without(df: DataFrame, removed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table without some columns, and its profile made anew: what was chosen for the old columns no longer holds."""
    left = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in set(removed)))
    return left, profile(left)
