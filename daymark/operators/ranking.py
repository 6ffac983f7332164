"""Places in an order of all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept

#: Bits below a partition's number in what monotonically_increasing_id() gives.
ROW_BITS = 33


def placed(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with place, from 1 in an order of all rows, and for each column of sums upto_column, its sum up to the row.

    The order must tell rows apart where their places are to be the same in each run. Rows are dealt into ranges of the
    order and sorted there, and that is written once, as ranges are drawn from a sample. Only the number of rows and
    the sums of each range meet in one task, and go back to the ranges as a table of at most one row a range.
    """
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.shiftright(row, ROW_BITS), "row": row.bitwiseAND((1 << ROW_BITS) - 1)})
    own = kept(ranged, "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in sums))
    # one row a range
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), *(F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumns({f"upto_{c}": F.sum(c).over(within) for c in sums}).join(F.broadcast(starts), "part")
    return out.select(*df.columns, (F.col("n_before") + F.col("row") + 1).alias("place"), *((F.col(f"before_{c}") + F.col(f"upto_{c}")).alias(f"upto_{c}") for c in sums))
