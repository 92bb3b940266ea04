"""Laplace noise on columns, one draw per finite cell in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.numeric import bounded_noise, finite, parse_float
from cloakframe.functions.prng import draw
from cloakframe.sources.tables import settle


def number_of(df: DataFrame, column: str) -> Column:
    """The finite number in a cell, null where there is none."""
    x = parse_float(F.col(f"`{column}`")) if dict(df.dtypes)[column] == "string" else F.col(f"`{column}`").cast("double")
    return F.when(finite(x), x)


def drawn(df: DataFrame, columns: Sequence[str], order: list[str], seed: int, base: int = 0) -> tuple[DataFrame, int]:
    """The rows with ``_x0``, ``_x1``, ...: the cells' numbers or null, and ``_u0``, ``_u1``, ...: the draws that finite cells consume (of no meaning elsewhere).

    The rows are cut into ranges of the order and written once, with the
    numbers of all columns; a draw's number is the count of finite cells of the
    columns before, of the ranges before, and of the rows before within the
    range. Returns the draws used in all as well.
    """
    numbers = df.select("*", *(number_of(df, c).alias(f"_x{i}") for i, c in enumerate(columns)))
    rows = settle(numbers.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    # one row per range and as many sums as columns: what a range's own number of rows is to a table, this is to its ranges
    counts = rows.groupBy("_part").agg(*(F.count(f"_x{i}").alias(f"_n{i}") for i in range(len(columns))))
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.agg(*(F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(columns)))).first()
    starts = [base + sum(whole[:i]) for i in range(len(columns))]
    before = counts.select("_part", *(F.coalesce(F.sum(f"_n{i}").over(past), F.lit(0)).alias(f"_b{i}") for i in range(len(columns))))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.select("*", *(F.count(f"_x{i}").over(own).alias(f"_k{i}") for i in range(len(columns)))).join(before, "_part")
    # also where there is no number: inside a condition the parts of a draw that recur would be evaluated each time
    at = [draw(seed, F.col(f"_k{i}") + F.col(f"_b{i}") + start).alias(f"_u{i}") for i, start in enumerate(starts)]
    keep = [F.col(f"`{c}`") for c in df.columns] + [F.col(f"_x{i}") for i in range(len(columns))]
    return seen.select(*keep, *at), base + sum(whole)


def noised_column(
    df: DataFrame, column: str, order: list[str], seed: int, base: int = 0, maximum: float = 100.0, share: float = 0.05, boundaries: Sequence[float] | None = None
) -> DataFrame:
    """The rows with ``column`` noised (as double, null where it was no number) and ``failed``."""
    rows, _ = drawn(df, [column], order, seed, base)
    noise = bounded_noise(F.col("_x0"), F.col("_u0"), maximum or 100.0, share or 0.05, boundaries)
    out = rows.withColumn("_noise", noise)  # of no number there is no noise
    return out.withColumn(column, F.col("_noise.value")).withColumn("failed", F.col("_x0").isNotNull() & F.coalesce("_noise.failed", F.lit(False))).drop("_x0", "_u0", "_noise")


def noised_table(
    df: DataFrame, columns: Sequence[str], order: list[str], seed: int, used: int = 0, maximum: float = 100.0, share: float = 0.05, boundaries: Sequence[float] | None = None
) -> tuple[DataFrame, DataFrame, int]:
    """All numeric columns of a text table noised in column order, rows within; other cells stay as they are.

    Returns the table, one row per column with its failures, and the number of draws used in all.
    """
    if not columns:
        return df, df.sparkSession.createDataFrame([], "column string, failures long"), used
    rows, used = drawn(df, columns, order, seed, used)
    noise = [bounded_noise(F.col(f"_x{i}"), F.col(f"_u{i}"), maximum or 100.0, share or 0.05, boundaries).alias(f"_z{i}") for i in range(len(columns))]
    moved = settle(rows.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"_x{i}") for i in range(len(columns))), *noise), "noised")
    failed = moved.agg(*(F.coalesce(F.sum(F.when(F.col(f"_x{i}").isNotNull(), F.col(f"_z{i}.failed").cast("int"))), F.lit(0)).cast("long").alias(f"f{i}") for i in range(len(columns))))
    total = failed.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("failures")) for i, c in enumerate(columns)))).alias("x")).select("x.*")

    def cell(i: int, c: str) -> Column:
        v = F.col(f"_z{i}.value")
        return F.when(v.isNull(), F.col(f"`{c}`")).otherwise(F.when(v == F.floor(v), F.floor(v).cast("long").cast("string")).otherwise(v.cast("string"))).alias(c)

    at = {c: i for i, c in enumerate(columns)}
    return moved.select(*(cell(at[c], c) if c in at else F.col(f"`{c}`") for c in df.columns)), total, used
