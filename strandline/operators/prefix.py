"""Running sums over all rows without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, order: str, value: str, inclusive: str | None = None, exclusive: str | None = None, block: int = 4096) -> DataFrame:
    """Adds the sums of ``value`` up to and with each row, and before it, in order of the integer column ``order``.

    Rows are summed inside blocks of ``block`` consecutive values of ``order``, the blocks' totals in the same way inside blocks of blocks, and so on until one block
    is left: no task orders more than ``block`` rows, and a table of n rows takes log(n) / log(block) rounds. ``order`` must be unique and not negative; a null value counts as 0.
    """
    most = df.agg(F.max(order)).first()[0]
    levels = 1
    while (most or 0) // block**levels > 0:
        levels += 1

    def before(rows: DataFrame, level: int) -> DataFrame:
        """Adds _before, the sums of _sum before each row in order of _at."""
        inside = F.sum("_sum").over(Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        placed = rows.withColumn("_block", F.expr(f"_at div {block}"))
        out = placed.withColumn("_before", F.coalesce(inside, F.lit(0)))
        if level > 1:
            above = before(placed.groupBy(F.col("_block").alias("_at")).agg(F.sum("_sum").alias("_sum")), level - 1)
            out = out.join(above.select(F.col("_at").alias("_block"), F.col("_before").alias("_above")), "_block").withColumn("_before", F.col("_before") + F.col("_above")).drop("_above")
        return out.drop("_block")

    out = before(df.withColumn("_at", F.col(f"`{order}`").cast("long")).withColumn("_sum", F.coalesce(F.col(value), F.lit(0)).cast("long")), levels)
    for name, x in ((inclusive, F.col("_before") + F.col("_sum")), (exclusive, F.col("_before"))):
        if name:
            out = out.withColumn(name, x)
    return out.drop("_at", "_sum", "_before")
