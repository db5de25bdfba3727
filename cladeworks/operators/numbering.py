"""Numbers of rows in the order of a table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.scratch import small, stage


def numbered(df: DataFrame, *order: str, name: str = "no") -> DataFrame:
    """``df`` with ``name BIGINT``: the row's place from 0 by the columns ``order``.

    Rows are sorted by ranges and written once; a row's place is its place in its range plus the sizes of the ranges before,
    of which there are as many as partitions.
    """
    at = F.monotonically_increasing_id()  # partition in the upper bits, place in the partition below
    rows = stage(df.orderBy(*order).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return rows.join(small(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))
