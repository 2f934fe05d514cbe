"""Places and running sums over all rows, without a window that one task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

_INSIDE = (1 << 33) - 1


def placed(rows: DataFrame, order: list[Column], place: str = "place", weight: str | None = None, before: str = "before") -> DataFrame:
    """rows with ``place`` (from 0, in ``order`` over all rows) and, with ``weight``, ``before``: the sum of the weights of the rows that come first.

    Rows are dealt out by ranges of the order and sorted there; the ranges'
    counts and sums, one row each, are added up and joined back. ``order`` must
    tell rows apart: equal ones stay in one range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = list(rows.columns)
    d = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "places")
    d = d.withColumn("_part", F.shiftright("_id", 33))
    w = F.col(weight) if weight else F.lit(0)
    sums = d.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(w).alias("_w"))  # a row a range
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *[F.coalesce(F.sum(c).over(first), F.lit(0)).alias(c) for c in ("_n", "_w")])
    d = d.join(F.broadcast(sums), "_part").withColumn(place, F.col("_n") + F.col("_id").bitwiseAND(_INSIDE))
    if weight:
        inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn(before, F.col("_w") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return d.select(*own, place, *([before] if weight else []))
