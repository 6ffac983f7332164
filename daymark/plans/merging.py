"""Rows to learn from: receipts with the features of their user, merchant, coupon and pairs as of that day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_number, with_day_parts
from ..operators.shaping import filled_by_type, prefixed, with_discount
from .definitions import KEYS
from .snapshots import dealt

ORDER = ("user", "merchant", "coupon", "user_merchant", "user_coupon")


def merged(rows: DataFrame, discounts: DataFrame, by_entity: dict[str, DataFrame], separator: str = ":", fill: bool = False, parts: int | None = None) -> DataFrame:
    """Five left joins on (key, day); feature tables have one row a key and day, so rows stay as many.

    Features are prefixed with their entity, but not those of user_coupon. fill: 0 for what is missing. parts: in how many
    parts each join is done. The entities with fewest features come first and the calendar last, as each join deals out
    the columns of those before it; the columns' order is that of ORDER all the same.
    """
    out = with_discount(rows, discounts)
    columns = with_day_parts(out, "date").columns
    # the calendar is told from the day itself, the joins are by its number
    out = out.withColumns({"day": F.col("date"), "date": day_number(F.col("date"))})
    own = {e: by_entity[e] if e == "user_coupon" else prefixed(by_entity[e], e, (*KEYS[e], "date"), separator) for e in ORDER}
    for e in ORDER:
        keys = [*KEYS[e], "date"]
        columns = [*keys, *(c for c in (*columns, *own[e].columns) if c not in keys)]
    for e in sorted(ORDER, key=lambda e: len(own[e].columns)):
        keys = (*KEYS[e], "date")
        out = dealt(out, parts, *keys).join(dealt(own[e], parts, *keys), list(keys), "left")
    number = "date_number"
    out = with_day_parts(out.withColumnsRenamed({"date": number, "day": "date"}), "date").drop("date").withColumnRenamed(number, "date").select(*(F.col(f"`{c}`") for c in columns))
    return filled_by_type(out, ("user_id", "merchant_id", "coupon_id", "date", "label")) if fill else out
