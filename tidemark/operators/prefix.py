"""Running aggregates over a whole ordered table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block; the unpartitioned window sees one row a block.
BLOCK = 1 << 16


def running(df: DataFrame, order: str, value: Column, name: str, how: str = "sum", block: int = BLOCK, strict: bool = True) -> DataFrame:
    """df with the sum or max of value over all rows before it by the bigint column `order` (unique, dense).

    strict leaves the row's own value out. Rows are dealt to blocks of the order; block totals are
    accumulated in a small window, and each block is accumulated on its own.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    tagged = df.withColumn("_block", F.floor(F.col(order) / block).cast("long")).withColumn("_value", value)
    totals = tagged.groupBy("_block").agg(fold("_value").alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_block", fold("_total").over(before).alias("_base"))
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    joined = tagged.join(base, "_block").withColumn("_own", fold("_value").over(within))
    both = F.coalesce("_base", F.lit(0)) + F.coalesce("_own", F.lit(0)) if how == "sum" else F.greatest("_base", "_own")
    return joined.withColumn(name, both).drop("_block", "_value", "_base", "_own")
