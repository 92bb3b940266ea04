"""Cells of text: guards, names, contexts, matches with positions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed from cells.
SPACES = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Word boundary between ASCII word characters; Java's own is aware of all of Unicode.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def sanitise(c: Column) -> Column:
    """Quote a cell that a spreadsheet would read as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), c)).otherwise(c)


def normal_name_order(c: Column) -> Column:
    """``Sur, First`` as ``First Sur``, split at the first comma, if both sides are filled."""
    comma = F.instr(c, ",")
    before, after = trimmed(F.substring(c, F.lit(1), comma - 1)), trimmed(F.substring(c, comma + 1, F.length(c)))
    return F.when((comma > 0) & (before != "") & (after != ""), F.concat_ws(" ", after, before)).otherwise(c)


def context(text: Column, position: Column, length: Column, around: int = 15) -> Column:
    """The match and up to ``around`` characters on both sides, with dots where more is cut off. Positions count from 0."""
    start = F.greatest(position - around, F.lit(0))
    stop = F.least(position + length + around, F.length(text))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, stop - start), F.when(stop < F.length(text), "...").otherwise(""))


def matches(text: Column, pattern: str) -> Column:
    """Array of (value, position) of all matches from left to right, positions from 0, found inside the JVM."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("between"))
    none = F.array().cast("array<struct<value:string,position:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["between"])
        item = F.struct(x["value"].alias("value"), at.alias("position"))
        # what follows the last match has no value
        return F.when(x["value"].isNull(), acc).otherwise(F.struct((at + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(item)).alias("out")))

    return F.when(text.rlike(pattern), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(none)


def nfkc(c: Column) -> Column:
    """Compatibility composition, which the JVM functions lack."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return compose(c)
