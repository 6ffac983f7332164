"""Entity statistics over fixed ranges of days, and their join with label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.shaping import bought_without, filled_by_type, prefixed, received_coupons, used_coupons
from ..schema import NO_DISTANCE
from ..sources.files import kept


def named(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return prefixed(df, prefix, (key,))


def of_users(rows: DataFrame, rest: list[Column], spreads: list[DataFrame], prefix: str, days: tuple[str, ...]) -> DataFrame:
    """Statistics of users: the given columns and the last days in one aggregation, which is written, as it is read for
    each day's first fifth as well; how rows spread over other keys; and whether a user is active by each day."""
    own = kept(stats.by_group(rows, "user_id", [*rest, *(F.max(d).alias(f"last_{d}") for d in days)]), "users")
    parts = [own.drop(*(f"last_{d}" for d in days)), *spreads]
    active = [named(stats.first_fifth(own, f"last_{d}"), "user_id", f"{prefix}_{d}") for d in days]
    return stats.aligned([named(stats.aligned(parts, "user_id"), "user_id", prefix), *active], "user_id")


def user_coupons(rows: DataFrame, prefix: str, with_distance: bool) -> DataFrame:
    """Three scans: how rows spread over coupons and over merchants, and everything else in one aggregation."""
    rest = [*stats.discount_columns(rows), *stats.hold_columns(), *stats.date_columns("date_received"), *stats.date_columns("date"), *(stats.six("distance", "distance") if with_distance else [])]
    return of_users(rows, rest, [stats.coupons(rows, "user_id"), stats.to_merchants(rows)], prefix, ("date", "date_received"))


def user_clicks(clicks: DataFrame, prefix: str) -> DataFrame:
    rest = [*stats.six("count", "click_count", ("max", "median")), *stats.date_columns("date")]
    return of_users(clicks, rest, [stats.to_merchants(clicks)], prefix, ("date",))


def user_features(offline: DataFrame, clicks: DataFrame, online_coupon: DataFrame) -> DataFrame:
    offline = offline.na.fill({"distance": NO_DISTANCE})
    return stats.aligned([user_coupons(offline, "user_offline", True), user_clicks(clicks, "user_online_click"), user_coupons(online_coupon, "user_online_coupon", False)], "user_id")


def merchant_features(offline: DataFrame) -> DataFrame:
    offline = offline.na.fill({"distance": NO_DISTANCE})
    key = "merchant_id"
    received, used, without = received_coupons(offline), used_coupons(offline), bought_without(offline)
    dated, far = stats.date_columns, stats.six("distance", "distance")
    parts = [
        stats.aligned([stats.coupons(received, key), stats.by_group(received, key, [*stats.discount_columns(received), *dated("date_received")]), stats.to_users(received, key)], key),
        stats.aligned([stats.coupons(used, key), stats.by_group(used, key, [*stats.discount_columns(used), *stats.hold_columns(), *dated("date_received"), *dated("date"), *far]), stats.to_users(used, key)], key),
        stats.aligned([stats.by_group(without, key, [*dated("date"), *far]), stats.to_users(without, key)], key),
    ]
    out = stats.aligned([named(x, key, n) for x, n in zip(parts, ("received_coupon", "buy_with_coupon", "buy_without_coupon"), strict=True)], key)
    return named(out.select("*", stats.transfer(out, "received_coupon_coupon_count", "buy_with_coupon_coupon_count")), key, "merchant_offline")


def usage_by(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """How receipts and uses of a coupon, discount or distance spread over users."""
    parts = [named(stats.to_users(x, key), key, n) for x, n in ((received_coupons(rows), "received_coupon"), (used_coupons(rows), "buy_with_coupon"))]
    return named(stats.aligned(parts, key), key, prefix)


def coupon_features(offline: DataFrame) -> DataFrame:
    return usage_by(offline, "coupon_id", "coupon_offline")


def distance_features(offline: DataFrame) -> DataFrame:
    return usage_by(offline.na.fill({"distance": NO_DISTANCE}), "distance", "distance_offline")


def discount_features(offline: DataFrame, online_coupon: DataFrame) -> DataFrame:
    return stats.aligned([usage_by(offline, "discount_name", "discount_offline"), usage_by(online_coupon, "discount_name", "discount_online")], "discount_name")


def merged_classic(rows: DataFrame, users: DataFrame, merchants: DataFrame, coupons: DataFrame, discounts: DataFrame, distances: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Label rows with all five entities' statistics, nothing missing, and without ids unless they are asked for.

    A missing distance is filled after the join, so such rows meet no distance statistics.
    """
    out = rows
    for df, key in ((users, "user_id"), (merchants, "merchant_id"), (coupons, "coupon_id"), (discounts, "discount_name"), (distances, "distance")):
        out = out.join(df, key, "left")
    out = out.na.fill({"distance": NO_DISTANCE})
    ids = ("user_id", "merchant_id", "coupon_id", "discount_name", "date", "date_received")
    return filled_by_type(out if keep_ids else out.drop(*ids), ("label", *ids))
