"""Row numbers without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.sources.tables import settle


def numbered(df: DataFrame, order: list[str], name: str = "_ord", start: int = 1) -> DataFrame:
    """The rows with their number in the given order, from ``start``.

    Rows are cut into ranges of the order, written once so that the ranges
    stay as they are, and numbered within each range after the rows of the
    ranges before it. ``order`` should tell all rows apart.
    """
    part = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(*order)
    return part.withColumn("_r", F.row_number().over(own)).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_r") + F.col("_before") + (start - 1)).drop("_part", "_r", "_before")
