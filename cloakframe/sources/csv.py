"""CSV in and out."""

from __future__ import annotations

import csv as _csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cloakframe.operators.columns import sanitised

#: A small class sheet for trying things out.
SAMPLE_HEADERS = ("Name", "Gender", "SEN", "PP", "EAL", "Score (%)", "Attendance (%)", "Comments")


def from_rows(spark: SparkSession, headers: Sequence[str], rows: Sequence[Sequence], order: str | None = "_ord") -> DataFrame:
    """A table of strings; short rows are filled with empty cells, null stays null."""
    width = len(headers)
    data = [tuple(None if c is None else str(c) for c in (list(r) + [""] * width)[:width]) + ((i,) if order else ()) for i, r in enumerate(rows)]
    schema = ", ".join(f"`{h}` string" for h in headers) + (f", `{order}` long" if order else "")
    return spark.createDataFrame(data, schema)


def from_text(spark: SparkSession, text: str, order: str | None = "_ord") -> DataFrame:
    """A CSV text: trimmed, cut into lines before quotes are read, blank lines dropped, all cells strings.

    A carriage return stays in the last cell and a line break within quotes is not supported.
    """
    lines = [x for x in text.strip().split("\n") if x.strip()]
    cells = [next(_csv.reader(io.StringIO(x, newline=""), strict=False), []) if "\r" not in x else _quoted(x) for x in lines]
    return from_rows(spark, cells[0] if cells else [], cells[1:], order)


def _quoted(line: str) -> list[str]:
    """Cells of a line that holds carriage returns, which the csv module would take for its end."""
    out = next(_csv.reader(io.StringIO(line.replace("\r", "\x00"), newline=""), strict=False), [])
    return [c.replace("\x00", "\r") for c in out]


def read(spark: SparkSession, path: str, strict: bool = False, delimiter: str = ",") -> DataFrame:
    """CSV files of any size, every column a string. ``strict`` fails on rows that do not parse and on tables without rows."""
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', sep=delimiter, multiLine=False, mode="FAILFAST" if strict else "PERMISSIVE")
    if strict and df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files as texts."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def sample(spark: SparkSession) -> DataFrame:
    """A made-up class sheet in the usual shape."""
    first = ("Asha", "Brin", "Corin", "Dalia", "Edwy", "Fenna", "Goran", "Hesper")
    rows = [
        (f"{n} Wold{chr(97 + i)}r", "FM"[i % 2], ("No", "K", "EHCP")[i % 5 // 2 if i % 5 < 5 else 0], ("No", "Yes")[i % 3 == 0], ("No", "Yes")[i % 4 == 0], 42 + 5 * i, 74 + 3 * i, "" if i % 3 else f"Lost focus after lunch on 0{i + 1}/03/2025")
        for i, n in enumerate(first)
    ]
    return from_rows(spark, SAMPLE_HEADERS, rows)


def write(df: DataFrame, path: str, guard: bool = True, mode: str = "error") -> None:
    """CSV files with headings, cells guarded against formulas."""
    (sanitised(df) if guard else df).write.mode(mode).csv(path, header=True, quote='"', escape='"')
