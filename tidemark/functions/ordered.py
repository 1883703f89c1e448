"""Places and running sums in a total order without a window over all rows.

Rows are range-dealt by the order, so that slice numbers follow it. A window runs inside a slice (and group), and the
slices' own totals, one row a slice and group, are what is summed across them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.scratch import written


def running(df: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with name: the sum of value over all rows (of the same by) up to and with this one; order must tell all rows
    of a group apart. A hot group is spread over slices, as the order goes on inside it."""
    by = by or []
    dealt = written(df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_slice").agg(F.sum(value).alias("_n"))
    part = W.partitionBy(*by).orderBy("_slice") if by else W.orderBy("_slice")
    before = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), (F.sum("_n").over(part) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_in", F.sum(value).over(W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(before, same).select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def positions(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with pos, the place from 0 in the given order (of rows of the same by)."""
    ones = running(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", "pos", by)
    return ones.drop("_one").withColumn("pos", F.col("pos") - 1)
