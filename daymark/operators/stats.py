"""Statistics by group key. Rows without the key don't count; each input is aggregated once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DATE_FLAGS, date_fields
from .ranking import placed
from .shaping import was_kept, was_used

#: Share of users, by their last day, that count as active.
ACTIVE_SHARE = 0.2


def most_frequent(x: Column) -> Column:
    """The most frequent value, the smallest of several."""
    return F.mode(x, True)


def six(column: str | Column, prefix: str, names: Iterable[str] = ("max", "min", "median", "mean", "std", "most_freq")) -> list[Column]:
    """Aggregates of a column, named prefix_max and so on. The deviation of a single row is null."""
    x = F.col(column) if isinstance(column, str) else column
    made = {"max": F.max(x), "min": F.min(x), "median": F.percentile(x, 0.5), "mean": F.avg(x), "std": F.stddev_samp(x), "most_freq": most_frequent(x)}
    return [made[n].alias(f"{prefix}_{n}") for n in names]


def aligned(frames: list[DataFrame], key: str) -> DataFrame:
    """All groups of several inputs: a full outer join on their key."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames)


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """How often each value occurs in each group; missing values don't."""
    return df.dropna(subset=[key, value]).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def spread_of(df: DataFrame, key: str, value: str, count_name: str, distinct_name: str, prefix: str, names: Iterable[str]) -> DataFrame:
    """Rows and distinct values of each group, and statistics of how often a value occurs.

    Two levels: counts by (key, value), which combine before the shuffle, then statistics over those.
    """
    pairs = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    return pairs.withColumn("known", known).groupBy(key).agg(F.sum("n").alias(count_name), F.count("known").alias(distinct_name), *six("known", prefix, names))


def to_users(df: DataFrame, key: str) -> DataFrame:
    """user_count, user_nunique and the spread of a group's rows over its users."""
    return spread_of(df, key, "user_id", "user_count", "user_nunique", "user_usage", ("min", "max", "median", "mean", "std", "most_freq"))


def to_merchants(df: DataFrame) -> DataFrame:
    return spread_of(df, "user_id", "merchant_id", "merchant_count", "merchant_nunique", "merchant_value_count", ("max", "mean", "median", "std", "most_freq"))


def by_group(df: DataFrame, key: str, columns: list[Column]) -> DataFrame:
    """Any number of these modules' columns of each group, in one aggregation."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*columns)


def coupons(df: DataFrame, key: str) -> DataFrame:
    return spread_of(df, key, "coupon_id", "coupon_count", "coupon_nunique", "coupon_value_count", ("max", "mean", "median", "std", "most_freq"))


def discount_columns(df: DataFrame, with_kinds: bool = False) -> list[Column]:
    """Discount statistics, and transfer_rate: receipts that weren't used over uses, null where there are none of either.

    with_kinds adds how many rows are of each kind of discount.
    """
    fields = [a for c in ("discount_man", "discount_jian", "discount_rate") for a in six(c, c)]
    kinds = [F.count_if(F.col(f"is_{k}")).alias(f"{k}_count") for k in ("xianshi", "manjian", "dazhe") if with_kinds and f"is_{k}" in df.columns]
    some = lambda p: F.nullif(F.count_if(p), F.lit(0))
    return [*fields, *kinds, (some(was_kept(df)) / some(was_used(df))).alias("transfer_rate")]


def discounts(df: DataFrame, key: str, with_kinds: bool = False) -> DataFrame:
    """Coupon counts and discount statistics by key."""
    return coupons(df, key).join(by_group(df, key, discount_columns(df, with_kinds)), key)


def distances(df: DataFrame, key: str) -> DataFrame:
    return by_group(df, key, six("distance", "distance"))


def date_columns(column: str) -> list[Column]:
    """Whether any date of a group has each calendar flag."""
    fields = date_fields(F.col(column))
    return [F.coalesce(F.bool_or(fields[f]), F.lit(False)).alias(f"{column}_{f}") for f in DATE_FLAGS]


def any_date(df: DataFrame, column: str, key: str) -> DataFrame:
    return by_group(df, key, date_columns(column))


def hold_columns() -> list[Column]:
    """Statistics of the days between receipt and use."""
    return six(F.datediff("date", "date_received").cast("double"), "coupon_hold_days")


def hold_days(df: DataFrame, key: str) -> DataFrame:
    return by_group(df, key, hold_columns())


def transfer(df: DataFrame, source: str, target: str) -> Column:
    return F.try_divide(F.col(target), F.col(source)).alias(f"transfer_rate_{source}_to_{target}")


def click_spread(df: DataFrame) -> DataFrame:
    return df.where("user_id is not null").groupBy("user_id").agg(*six("count", "click_count", ("max", "median")))


def first_fifth(last: DataFrame, day: str) -> DataFrame:
    """(user_id, is_active): whether a user is in the first fifth by a day, later ones first, none last, ties by user_id.

    Users get their places from ranges of the order, so no task sees all of them, nor all of one day.
    """
    own = placed(last.select("user_id", day), [F.col(day).desc_nulls_last(), F.col("user_id")])
    quota = own.agg(F.floor(F.count(F.lit(1)) * ACTIVE_SHARE).alias("quota"))
    # one row
    return own.crossJoin(F.broadcast(quota)).select("user_id", (F.col("place") <= F.col("quota")).alias("is_active"))


def most_active(df: DataFrame, column: str) -> DataFrame:
    """first_fifth of the users by their last day."""
    return first_fifth(df.where("user_id is not null").groupBy("user_id").agg(F.max(column).alias("last_day")), "last_day")
