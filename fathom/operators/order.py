"""Numbers, running sums and windows in one order over all rows, without bringing the rows into one task.

Rows are dealt by ranges of the order and sorted inside each range; the ranges' sizes (a row for each partition) give where each
begins. The dealt rows are stored, so that they are the same in all that follows. Windows over numbered rows are made in
stretches, each with the rows around it that its windows reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.runtime import stored

#: Rows of a stretch.
STRETCH = 1 << 16


def dealt(rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """rows in ranges of the order, stored: __p (range) and __i (place in it, from 0)."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inside = rows.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    kept = stored(inside.withColumn("__id", F.monotonically_increasing_id()))  # the partition's number stands above 33 bits
    return kept.select(*rows.columns, F.shiftright("__id", 33).alias("__p"), (F.col("__id").bitwiseAND((1 << 33) - 1)).alias("__i"))


def begun(ranges: DataFrame, size: Column) -> DataFrame:
    """__p and __before: the sum of `size` over all earlier ranges; a row for each range, which fits a broadcast."""
    sums = ranges.groupBy("__p").agg(F.sum(size).alias("__size")).orderBy("__p").collect()
    before, total = [], 0
    for r in sums:
        before.append((r["__p"], total))
        total += r["__size"]
    return F.broadcast(ranges.sparkSession.createDataFrame(before, "__p long, __before long"))


def numbered(rows: DataFrame, order_by: Sequence[str], out: str = "rn") -> DataFrame:
    """rows with their number in the order, from 1."""
    ranges = dealt(rows, order_by)
    return ranges.join(begun(ranges, F.lit(1)), "__p").select(*rows.columns, (F.col("__before") + F.col("__i") + 1).alias(out))


def running(rows: DataFrame, order_by: str, weight: str, out: str) -> DataFrame:
    """rows with the sum of whole weights of all rows up to theirs, where values of the order are different."""
    ranges = dealt(rows, [order_by])
    inside = F.sum(weight).over(Window.partitionBy("__p").orderBy("__i"))
    return ranges.withColumn("__sum", inside).join(begun(ranges, F.col(weight)), "__p").select(*rows.columns, (F.col("__before") + F.col("__sum")).alias(out))


def stretched(rows: DataFrame, number: str, before: int, after: int, stretch: int = STRETCH) -> DataFrame:
    """rows in stretches __b of their numbers, each with the rows `before` and `after` its own; __own marks its own rows."""
    size = max(stretch, before + after)
    block = lambda x: F.floor(x / size)
    at = F.col(number)
    reach = F.sequence(block(F.greatest(at - after, F.lit(0))), block(at + before))
    return rows.select("*", F.explode(reach).alias("__b")).withColumn("__own", F.col("__b") == block(at))
