"""Ranks over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import materialise


#: Rows that one task sorts.
SLICE = 1_000_000


def ranked(df: DataFrame, order: list[Column], name: str = "rank", slices: int | None = None) -> DataFrame:
    """``df`` with the place of each row, from 1, in a total order.

    Rows are range-partitioned and written once; each slice numbers its own rows
    and starts where the slices before it end. Only the slices' sizes reach the
    driver, a number for each ``SLICE`` rows. Rows that the order can't tell
    apart are numbered as they come.
    """
    slices = slices or max(8, -(-df.count() // SLICE))
    part = df.repartitionByRange(slices, *order).withColumn("__slice", F.spark_partition_id())
    part = materialise(part, "ranked")
    sizes = {r["__slice"]: r["n"] for r in part.groupBy("__slice").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for s in sorted(sizes):
        starts.append((s, total))
        total += sizes[s]
    before = df.sparkSession.createDataFrame(starts, "__slice int, __before bigint")
    inside = part.withColumn("__inside", F.row_number().over(Window.partitionBy("__slice").orderBy(*order)))
    return inside.join(F.broadcast(before), "__slice").withColumn(name, F.col("__inside") + F.col("__before")).drop("__slice", "__inside", "__before")
