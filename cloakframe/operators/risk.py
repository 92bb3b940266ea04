"""Re-identification risk of a table (G1-G9): small groups, rare values, recommendations, tiers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.numeric import GRADE_BOUNDARIES, attendance_band, grade_band, parse_float
from cloakframe.sources.lexicon import generalisations_table

# Fixed values.
SMALL_CLASS, SMALL_K, USUAL_K, RARE_CAP = 20, 5, 3, 3
SMALL_COHORT = 15


def _q(c: str) -> str:
    return f"`{c}`"


def auto_k(rows: int) -> int:
    return SMALL_K if rows < SMALL_CLASS else USUAL_K


def chosen_k(df: DataFrame, k: int | str | None = "auto") -> int:
    """The given k, or the one that fits the number of rows."""
    return int(k) if k not in ("auto", None, 0) else auto_k(df.count())


def cell(c: str) -> Column:
    """A cell as text, null as empty."""
    return F.coalesce(F.col(_q(c)).cast("string"), F.lit(""))


def groups(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Every combination of attributes with its number of rows; partial counts are combined before the shuffle."""
    return df.select(*(cell(c).alias(c) for c in attributes)).groupBy(*map(_q, attributes)).agg(F.count("*").alias("count"))


def small_groups(df: DataFrame, attributes: Sequence[str], k: int) -> DataFrame:
    """The combinations that fewer than k rows share. Without attributes or rows there are none."""
    if not attributes:
        return df.sparkSession.createDataFrame([], "count long")
    return groups(df, attributes).filter(F.col("count") < k)


def small_group_rows(df: DataFrame, attributes: Sequence[str], k: int, order: str) -> DataFrame:
    """(attributes, count, row_ids, first): the small combinations as maps with their rows, fewer than k each, in report order.

    Counts come first, so that rows are gathered for small groups alone.
    """
    keyed = df.select(F.col(order).alias("_o"), *(cell(c).alias(c) for c in attributes))
    few = small_groups(df, attributes, k).drop("count")
    same = [keyed[_q(c)] == few[_q(c)] for c in attributes]
    rows = keyed.join(few, same, "left_semi")
    per = rows.groupBy(*map(_q, attributes)).agg(F.count("*").alias("count"), F.sort_array(F.collect_list("_o")).alias("row_ids"))
    described = F.create_map(*(x for c in attributes for x in (F.lit(c), F.col(_q(c)))))
    return per.select(described.alias("attributes"), F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.col(_q(c))) for c in attributes)).alias("described"), "count", "row_ids", F.col("row_ids")[0].alias("first")).orderBy("count", "first")


def k_summary(df: DataFrame, attributes: Sequence[str], k: int) -> DataFrame:
    """One row: threshold, total and safe rows."""
    if not attributes:
        return df.agg(F.lit(k).alias("threshold"), F.count("*").alias("total"), F.count("*").alias("safe"))
    n = F.col("count")
    return groups(df, attributes).agg(
        F.lit(k).alias("threshold"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(n >= k, n).otherwise(0)), F.lit(0)).alias("safe")
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, columnName, value, count) of every value of every column, in one aggregation."""
    long = F.explode(F.array(*(F.struct(F.lit(i).alias("column"), F.lit(c).alias("columnName"), cell(c).alias("value")) for i, c in enumerate(columns))))
    return df.select(long.alias("x")).select("x.*").groupBy("column", "columnName", "value").agg(F.count("*").alias("count"))


def rare_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The values that occur fewer than min(3, k) times."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column int, columnName string, value string, count long")
    return value_counts(df, columns).filter(F.col("count") < min(RARE_CAP, k))


def with_suggestions(rare: DataFrame, generalisations: DataFrame | None = None) -> DataFrame:
    """Rare values with what they may be generalised to.

    A known category gives its own suggestion or none; an unknown one the first
    of any category, in list order. The list may be a caller's of any size: the
    planner broadcasts it where its size allows.
    """
    g = generalisations if generalisations is not None else generalisations_table(rare.sparkSession)
    low = g.select("place", F.lower("category").alias("c"), F.lower("value").alias("v"), "suggestion")
    own = low.groupBy("c", "v").agg(F.min_by("suggestion", "place").alias("own")).withColumnRenamed("v", "v1")
    known = low.select(F.col("c").alias("kc")).distinct()
    anywhere = low.groupBy("v").agg(F.min_by("suggestion", "place").alias("any"))
    name, value = F.lower("columnName"), F.lower("value")
    return (
        rare.join(own, (name == F.col("c")) & (value == F.col("v1")), "left").join(known, name == F.col("kc"), "left").join(anywhere, value == F.col("v"), "left")
        .select("column", "columnName", "value", "count", F.when(F.col("kc").isNotNull(), F.col("own")).otherwise(F.col("any")).alias("suggestion"))
    )


def recommendations(summary: DataFrame, flagged: DataFrame, rare: DataFrame, k: int) -> DataFrame:
    """(part, place, text): plain-English advice, the summary first, then groups and rare values.

    ``flagged`` has described, count and first; ``rare`` has column, columnName, value, count and suggestion.
    """
    total, safe = F.col("total"), F.col("safe")
    left = total - safe
    one = F.when(total == 0, "No data to analyse.").when(left == 0, F.format_string(f"All %d students are in groups of {k}+. No re-identification risk detected from quasi-identifiers.", total)).otherwise(
        F.concat(F.format_string(f"%d of %d students are in groups of {k}+. %d student", safe, total, left), F.when(left == 1, " has").otherwise("s have"), F.lit(f" attribute combinations shared by fewer than {k} others."))
    )
    first = summary.select(F.lit(0).alias("part"), F.lit("").alias("place"), one.alias("text"))
    many = lambda c, word: F.concat(F.lit(word), F.when(c == 1, "").otherwise("s"))
    n = F.col("count")
    second = flagged.select(
        F.lit(1).alias("part"), F.format_string("%012d %020d", n, F.col("first").cast("long")).alias("place"),
        F.concat(F.lit("Group ("), "described", F.format_string("): %d ", n), many(n, "student"), F.lit(" — consider generalising or suppressing distinguishing attributes.")).alias("text"),
    )
    third = rare.select(
        F.lit(2).alias("part"), F.concat(F.format_string("%012d %06d ", n, F.col("column")), "value").alias("place"),
        F.concat(
            F.format_string('Rare category in "%s": "%s" appears only %d ', F.col("columnName"), F.col("value"), n), many(n, "time"), F.lit("."),
            F.coalesce(F.concat(F.lit(' Consider generalising to "'), "suggestion", F.lit('".')), F.lit("")),
        ).alias("text"),
    )
    return first.unionByName(second).unionByName(third)


@dataclass
class RiskReport:
    """Lazy parts of a report."""

    k: int
    summary: DataFrame
    flagged: DataFrame
    rare: DataFrame
    recommendations: DataFrame


def analyse(df: DataFrame, attributes: Sequence[str], categorical: Sequence[str], order: str, k: int | str | None = "auto", generalisations: DataFrame | None = None) -> RiskReport:
    """Small groups over the attributes, rare values of the categorical columns, and the advice that follows."""
    k = chosen_k(df, k)
    summary = k_summary(df, attributes, k)
    none = df.sparkSession.createDataFrame([], "attributes map<string,string>, described string, count long, row_ids array<long>, first long")
    flagged = small_group_rows(df, attributes, k, order) if attributes else none
    rare = with_suggestions(rare_values(df, categorical, k), generalisations)
    return RiskReport(k, summary, flagged, rare, recommendations(summary, flagged, rare, k))


def with_bands(df: DataFrame, numeric: Sequence[str], boundaries: Sequence[float] = GRADE_BOUNDARIES) -> tuple[DataFrame, list[str], list[str]]:
    """The table with grade bands of score-like columns and attendance bands, and the names of both."""
    number = lambda c: parse_float(cell(c))
    grades, attendances = {}, {}
    for c in numeric:
        if re.search("score|mark|grade|percent", c, re.I):
            grades[f"{c} Band"] = c
    for c in numeric:
        if re.search("attendance", c, re.I):
            attendances[f"{c} Band" if f"{c} Band" not in grades else f"{c} Attendance Band"] = c
    bands = {**{n: grade_band(number(c), boundaries) for n, c in grades.items()}, **{n: attendance_band(number(c)) for n, c in attendances.items()}}
    return (df.withColumns(bands) if bands else df), list(grades), list(attendances)


def quasi_identifiers(categorical: Sequence[str], gender: str | None, grades: Sequence[str], attendances: Sequence[str]) -> list[str]:
    """Categorical columns, gender, grade and attendance bands, each once."""
    return list(dict.fromkeys([*categorical, *([gender] if gender else []), *grades, *attendances]))


def cohort_tier(size: Column, headings: Sequence[str]) -> Column:
    """``high``, ``medium`` or ``low`` by the size of a cohort and sensitive headings."""
    if any(re.search("ehcp|lac|safeguard|medical", h, re.I) for h in headings):
        return F.lit("high")
    return F.when(size < 12, "high").when(size < 20, "medium").otherwise("low")


def cohorts(df: DataFrame, cohort: str) -> DataFrame:
    """(cohort, rows, tier, small): size, tier and small-cohort warning of every cohort."""
    headings = [c for c in df.columns if c != cohort]
    return df.groupBy(cohort).agg(F.count("*").alias("rows")).select(cohort, "rows", cohort_tier(F.col("rows"), headings).alias("tier"), (F.col("rows") < SMALL_COHORT).alias("small"))


def attribute_cube(df: DataFrame, attributes: Sequence[str], k: int) -> DataFrame:
    """Extension: small groups of every subset of the attributes, which ``attributes`` names; one row per subset."""
    marks = [F.grouping(_q(c)) for c in attributes]
    used = F.concat_ws(",", *(F.when(m == 0, c) for m, c in zip(marks, attributes)))
    cube = df.select(*(cell(c).alias(c) for c in attributes)).cube(*map(_q, attributes)).agg(F.count("*").alias("n"), used.alias("subset"))
    return cube.groupBy("subset").agg(F.count("*").alias("groups"), F.sum(F.when(F.col("n") < k, 1).otherwise(0)).alias("small_groups"), F.sum(F.when(F.col("n") < k, F.col("n")).otherwise(0)).alias("exposed_rows"))
