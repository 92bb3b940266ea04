"""Problem 1: rows that fail to parse, apart from the rows that load.

A raw line is cut into cells by one regular expression built from its upload's
delimiter; the line is well quoted exactly if the cells joined again give the
line. All rows are cut once and written with the cells that are to be checked.
Every distinct value of a checked heading is cast once; the values that cannot
be cast form a dictionary with the reason, and that dictionary is joined back
beside the structural checks.

Defined results: a null or blank line is skipped; a null cell is blank; null
``cells`` have no cells (``column_count`` unless there are no headings); a row
whose upload is unknown or has no headings fails as ``column_count``; a null
delimiter counts as a comma; repeated rows stay repeated; columns of the input
besides the named ones are kept out of the way by working on renamed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.sources.tables import settle

#: Marks that stand for a missing number.
MARKS = ("Absent", "N/A", "X", "-", "Withdrawn")
NUMBER_HEADING = r"Score|Attendance"
DATE_HEADINGS = ("DOB", "Date of Birth")
REASONS = ("quoting", "column_count", "value")


def cell_pattern(delimiter: Column) -> Column:
    """Pattern of one delimiter and the cell after it.

    All loops are possessive: Java runs them without recursion, so that long
    cells cannot overflow the stack.
    """
    d = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    return F.concat(d, F.lit('("[^"]*+(?:""[^"]*+)*+"(?='), d, F.lit('|\\z)|(?:(?!'), d, F.lit(')[^"])*+)'))


def split_line(line: Column, delimiter: Column) -> Column:
    """Cells of a line as written, still in their quotes."""
    return F.regexp_extract_all(F.concat(delimiter, line), cell_pattern(delimiter), F.lit(1))


def unquote(cell: Column) -> Column:
    inner = F.regexp_replace(F.substring(cell, F.lit(2), F.length(cell) - 2), '""', '"')
    return F.when(cell.startswith('"') & (F.length(cell) >= 2), inner).otherwise(cell)


def value_kind(heading: Column) -> Column:
    """``number``, ``date`` or null for a heading whose cells are not checked."""
    return F.when(heading.rlike(NUMBER_HEADING), "number").when(F.trim(heading).isin(*DATE_HEADINGS), "date")


def fault(kind: Column, value: Column) -> Column:
    """Why a distinct value cannot be cast under its kind of heading; null if it can."""
    v = F.trim(value)
    plain = F.regexp_extract(v, r"^(\d+(?:\.\d+)?)\s*%?$", 1).try_cast("double")
    number = F.when(v.isin(*MARKS), None).when(plain.isNull(), "not a number").when(~plain.between(0, 100), "out of range")
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v).when(
        v.rlike(r"^\d{2}/\d{2}/\d{4}$"),
        F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)),
    )
    date = F.when(iso.isNull(), "not a date").when(F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))).isNull(), "no such date")
    return F.when(v == "", None).when(kind == "number", number).otherwise(date)


def invalid_values(cells: DataFrame) -> DataFrame:
    """The dictionary (kind, value, why, n) of values that cannot be cast, each distinct value cast once."""
    counted = cells.groupBy("kind", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("why", fault(F.col("kind"), F.col("value"))).filter("why IS NOT NULL").select("kind", "value", "why", "n")


def structured(raw: DataFrame, parsed: DataFrame, uploads: DataFrame) -> DataFrame:
    """All rows of both tables as (origin, row_id, upload_id, headers, cells, structural reason)."""
    heads = uploads.groupBy("upload_id").agg(F.first("headers").alias("headers"), F.first("delimiter_char").alias("d"))
    r = (
        raw.select("row_id", "upload_id", "raw_line")
        .filter(F.col("raw_line").rlike(r"[^ ]"))
        .join(heads, "upload_id", "left")
        .withColumn("d", F.coalesce(F.nullif("d", F.lit("")), F.lit(",")))
        .withColumn("quoted", split_line(F.col("raw_line"), F.col("d")))
        .withColumn("whole", F.expr("array_join(quoted, d)") == F.col("raw_line"))
        .select(
            F.lit("raw_rows").alias("origin"), "row_id", "upload_id", "headers",
            F.transform("quoted", unquote).alias("cells"), F.when(~F.col("whole"), "quoting").alias("broken"),
        )
    )
    p = parsed.select("row_id", "upload_id", "cells").join(heads.drop("d"), "upload_id", "left").select(
        F.lit("parsed_rows").alias("origin"), "row_id", "upload_id", "headers", "cells", F.lit(None).cast("string").alias("broken")
    )
    fits = F.coalesce(F.size("cells") == F.size("headers"), F.lit(False))
    return r.unionByName(p).withColumn("broken", F.coalesce("broken", F.when(~fits, "column_count")))


def to_check(headers: Column, cells: Column) -> Column:
    """The filled cells under checked headings, as an array of (kind, value)."""
    pairs = F.arrays_zip(headers.alias("h"), cells.alias("c"))
    checked = F.transform(pairs, lambda x: F.struct(value_kind(x["h"]).alias("kind"), F.coalesce(x["c"], F.lit("")).alias("value")))
    return F.filter(checked, lambda x: x["kind"].isNotNull() & (F.trim(x["value"]) != ""))


def cut_once(raw: DataFrame, parsed: DataFrame, uploads: DataFrame, whole: bool = False) -> DataFrame:
    """The rows with their structural fault and the cells to check, written; with ``whole`` also upload, headings and all cells."""
    rows = structured(raw, parsed, uploads)
    check = F.when(F.col("broken").isNull(), to_check(F.col("headers"), F.col("cells"))).alias("check")
    return settle(rows.select("origin", "row_id", "broken", check, *(("upload_id", "headers", "cells") if whole else ())), "rows")


def checked_cells(rows: DataFrame) -> DataFrame:
    """(origin, row_id, kind, value) of the cells to check of written rows."""
    return rows.select("origin", "row_id", F.explode("check").alias("x")).select("origin", "row_id", "x.*")


def bad_values(rows: DataFrame) -> DataFrame:
    """(origin, row_id, why) of the sound rows that hold an invalid value, one per invalid cell.

    The values are counted before the shuffle, so that one held by a third of
    all rows costs one group per task. The dictionary is as large as the number
    of distinct bad values; the adaptive planner broadcasts it only when its
    measured size allows it and joins by shuffle otherwise.
    """
    cells = checked_cells(rows)
    return cells.join(invalid_values(cells).drop("n"), ["kind", "value"]).select("origin", "row_id", "why")


def rejected(raw: DataFrame, parsed: DataFrame, uploads: DataFrame) -> DataFrame:
    """(origin, row_id, reason) of the rows that do not load."""
    rows = cut_once(raw, parsed, uploads)
    broken = rows.filter("broken IS NOT NULL").select("origin", "row_id", F.col("broken").alias("reason"))
    return broken.unionByName(bad_values(rows).select("origin", "row_id", F.lit("value").alias("reason"))).distinct()


def value_faults(raw: DataFrame, parsed: DataFrame, uploads: DataFrame) -> DataFrame:
    """The dictionary of invalid values of both tables, with why each cannot be cast and how often it occurs."""
    return invalid_values(checked_cells(cut_once(raw, parsed, uploads)))


def loaded(raw: DataFrame, parsed: DataFrame, uploads: DataFrame) -> DataFrame:
    """The rows that load, as a map from heading to cell (a repeated heading keeps its last cell)."""
    rows = cut_once(raw, parsed, uploads, whole=True)
    pairs = F.arrays_zip(F.col("headers").alias("k"), F.col("cells").alias("v"))
    good = rows.filter("broken IS NULL").join(bad_values(rows), ["origin", "row_id"], "left_anti")
    entries = F.filter(F.transform(pairs, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))), lambda x: x["k"].isNotNull())
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return good.select("origin", "row_id", "upload_id", F.map_from_entries(last).alias("record"))
