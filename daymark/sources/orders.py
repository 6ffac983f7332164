"""A purchase log derived from order lines, for running everything on a star schema.

Lines of one year are offline or online by line status; by return flag a coupon was received only (A), received and
used (R), or there was none (N); late online lines without coupon are clicks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import dealt_at_least, read_table

YEAR = 1996


def order_lines(spark: SparkSession, folder: str, year: int = YEAR, in_parts: int | None = None) -> DataFrame:
    """(user_id, merchant_id, coupon_id, discount, distance, date_received, date, online, click, line): one row an order line.

    in_parts: in how many parts the joins are done at least; the smaller sides are dealt, and lines follow where they must.
    """
    first, last = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ordered")).where(F.col("ordered").between(first, last))
    items = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    parts = read_table(spark, folder, "part").select("p_partkey", "p_size")
    orders, parts = dealt_at_least(orders, in_parts, "o_orderkey"), dealt_at_least(parts, in_parts, "p_partkey")
    rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).join(parts, items["l_partkey"] == parts["p_partkey"])
    without, used = F.col("l_returnflag") == "N", F.col("l_returnflag") == "R"
    online, quantity = F.col("l_linestatus") == "O", F.col("l_quantity").cast("int")
    size = F.col("p_size") % 12
    whole = F.concat_ws(":", (quantity * 10).cast("string"), (F.col("l_suppkey") % 9 + 1).cast("string"))
    percent = (100 - F.round(F.col("l_discount") * 100)).cast("int").cast("string")
    date = F.when(used, F.date_add("ordered", quantity % 31)).when(without, F.col("ordered"))
    out = rows.select(
        F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("merchant_id"), F.when(~without, F.col("l_partkey").cast("string")).alias("coupon_id"),
        F.when(~without, F.when(F.col("l_linenumber") % 2 == 1, whole).otherwise(percent)).alias("discount"), F.when(~online & (size != 11), size.cast("double")).alias("distance"),
        F.when(~without, F.col("ordered")).alias("date_received"), date.alias("date"), online.alias("online"), (online & without & (F.col("l_linenumber") >= 5)).alias("click"),
        F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("order_id"),
    )
    return out.where(F.col("date").isNull() | (F.col("date") <= last))
