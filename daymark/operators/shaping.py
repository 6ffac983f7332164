"""From raw rows to typed rows, and from those to one event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compact_date, day_number, discount_struct, with_date_fields, with_discount_fields
from ..schema import BUY, CLICK, LABEL_DAYS, RAW_OFFLINE, RAW_ONLINE, RAW_TEST, RECEIVE, Split
from ..sources.files import dealt_at_least


def within(column: str, bounds: tuple[str, str]) -> Column:
    return F.col(column).between(F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date"))


def used_in_time(received: str = "date_received", used: str = "date") -> Column:
    """Whether a coupon was received and used within LABEL_DAYS; never null. There is no lower bound."""
    known = F.col("coupon_id").isNotNull() & F.col(received).isNotNull() & F.col(used).isNotNull()
    return F.coalesce(known & (F.datediff(used, received) <= LABEL_DAYS), F.lit(False))


def typed_offline(raw: DataFrame) -> DataFrame:
    """Raw offline rows with dates, discount fields (without is_xianshi) and the label."""
    own = raw.toDF("user_id", "merchant_id", "coupon_id", "discount", "distance", "date_received", "date")
    return labelled(own.withColumns({c: compact_date(F.col(c)) for c in ("date_received", "date")}))


def labelled(rows: DataFrame) -> DataFrame:
    return with_discount_fields(rows, "discount").drop("is_xianshi").withColumn("label", used_in_time())


def typed_online_coupon(raw: DataFrame) -> DataFrame:
    own = raw.toDF("user_id", "merchant_id", "action", "coupon_id", "discount", "date_received", "date").drop("action")
    return with_discount_fields(own.withColumns({c: compact_date(F.col(c)) for c in ("date_received", "date")}), "discount")


def typed_test(raw: DataFrame) -> DataFrame:
    own = raw.toDF("user_id", "merchant_id", "coupon_id", "discount", "distance", "date_received")
    return with_discount_fields(own.withColumn("date_received", compact_date(F.col("date_received"))), "discount").drop("is_xianshi")


def split_clicks(raw: DataFrame, action: str = "Action") -> tuple[DataFrame, DataFrame]:
    """Online rows that are clicks, and the others, missing actions among them."""
    is_click = F.col(action).eqNullSafe(CLICK)
    return raw.where(is_click), raw.where(~is_click)


def typed_clicks(raw: DataFrame) -> DataFrame:
    """(user_id, merchant_id, date, count) of raw clicks."""
    own = raw.toDF("user_id", "merchant_id", "action", "coupon_id", "discount", "date_received", "date")
    return click_counts(own.select("user_id", "merchant_id", compact_date(F.col("date")).alias("date")))


def raw_text(day: str) -> Column:
    return F.date_format(day, "yyyyMMdd")


def raw_offline(lines: DataFrame) -> DataFrame:
    """Lines as the columns of a raw offline file."""
    return lines.select("user_id", "merchant_id", "coupon_id", "discount", "distance", raw_text("date_received"), raw_text("date")).toDF(*RAW_OFFLINE.names)


def raw_online(lines: DataFrame) -> DataFrame:
    """Lines as the columns of a raw online file; what isn't a click is a purchase or a receipt alone."""
    action = F.when(F.col("click"), CLICK).when(F.col("date").isNotNull(), BUY).otherwise(RECEIVE)
    return lines.select("user_id", "merchant_id", action, "coupon_id", "discount", raw_text("date_received"), raw_text("date")).toDF(*RAW_ONLINE.names)


def raw_test(lines: DataFrame) -> DataFrame:
    """Received coupons as the columns of a raw test file, which doesn't tell the use."""
    own = lines.where(F.col("coupon_id").isNotNull() & F.col("date_received").isNotNull())
    return own.select("user_id", "merchant_id", "coupon_id", "discount", "distance", raw_text("date_received")).toDF(*RAW_TEST.names)


def click_counts(clicks: DataFrame) -> DataFrame:
    """(user_id, merchant_id, date, count); rows without one of the keys go."""
    keys = ["user_id", "merchant_id", "date"]
    return clicks.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def label_rows(rows: DataFrame, bounds: tuple[str, str]) -> DataFrame:
    """Received coupons of a range of days: those whose use is to be foretold."""
    return rows.where(F.col("coupon_id").isNotNull() & F.col("date_received").isNotNull() & within("date_received", bounds))


def feature_rows(rows: DataFrame, bounds: tuple[str, str]) -> DataFrame:
    """Rows whose dates, where they have any, lie in a range of days."""
    for c in ("date_received", "date"):
        if c in rows.columns:
            rows = rows.where(F.col(c).isNull() | within(c, bounds))
    return rows


def _label(rows: DataFrame) -> Column:
    return F.col("label") if "label" in rows.columns else F.col("date").isNotNull()


def _with_coupon() -> Column:
    return F.col("date_received").isNotNull() & F.col("coupon_id").isNotNull()


def was_kept(rows: DataFrame) -> Column:
    """Whether a row is a received coupon that wasn't used (in time, where rows are labelled)."""
    return ~_label(rows) & _with_coupon()


def was_used(rows: DataFrame) -> Column:
    return _label(rows) & _with_coupon()


def received_coupons(rows: DataFrame) -> DataFrame:
    return rows.where(was_kept(rows))


def used_coupons(rows: DataFrame) -> DataFrame:
    return rows.where(was_used(rows))


def bought_without(rows: DataFrame) -> DataFrame:
    return rows.where(~_label(rows) & F.col("coupon_id").isNull())


def rows_to_predict(rows: DataFrame) -> DataFrame:
    """Received coupons with the calendar fields of the day."""
    return with_date_fields(rows.where(F.col("coupon_id").isNotNull() & F.col("date_received").isNotNull()), "date_received")


def coupon_kind() -> Column:
    """What a coupon row tells: a purchase without coupon, one with, or a receipt alone."""
    without = F.col("coupon_id").isNull() | F.col("date_received").isNull()
    return F.when(without, F.lit("buy_without_coupon")).when(F.col("date").isNotNull(), F.lit("buy_with_coupon")).otherwise("receive_coupon")


def coupon_events(rows: DataFrame, line: str) -> DataFrame:
    """Events of coupon rows of one line (offline or online): a used coupon is a receipt and a purchase."""
    kind = coupon_kind()
    none, name = F.lit(None).cast("date"), lambda k: F.lit(f"{line}_{k}")
    one = lambda k, date, date2: F.struct(name(k).alias("event_type"), date.alias("date"), date2.alias("date2"))
    received, used = F.col("date_received"), F.col("date")
    events = F.when(kind == "buy_without_coupon", F.array(one("buy_without_coupon", used, none))).when(
        kind == "buy_with_coupon", F.array(one("receive_coupon", received, used), one("buy_with_coupon", used, received))
    ).otherwise(F.array(one("receive_coupon", received, none)))
    distance = F.col("distance") if line == "offline" else F.lit(None).cast("double")
    own = rows.select("user_id", "merchant_id", "coupon_id", "discount_name", distance.alias("distance"), F.explode(events).alias("e"))
    return own.select("e.date", "e.date2", "e.event_type", "user_id", "merchant_id", "coupon_id", "discount_name", "distance", F.lit(None).cast("double").alias("click_count"))


def click_events(counts: DataFrame) -> DataFrame:
    text, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    return counts.select(
        "date", F.lit(None).cast("date").alias("date2"), F.lit("online_click").alias("event_type"), "user_id", "merchant_id", text.alias("coupon_id"), text.alias("discount_name"), none.alias("distance"), F.col("count").cast("double").alias("click_count"),
    )


def test_events(rows: DataFrame) -> DataFrame:
    """Rows to predict as receipts whose use is unknown."""
    return coupon_events(rows.withColumn("date", F.lit(None).cast("date")), "offline")


def of_known_users(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of users that another table has."""
    return rows.join(known.select("user_id").distinct(), "user_id", "left_semi")


def event_log(offline: DataFrame, online_coupon: DataFrame, clicks: DataFrame, test: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One log of all events; online rows only of users that are seen offline, looked up in a number of parts at least."""
    known = offline.select("user_id") if test is None else offline.select("user_id").unionByName(test.select("user_id"))
    known = dealt_at_least(known, parts, "user_id")
    log = coupon_events(offline, "offline").unionByName(coupon_events(of_known_users(online_coupon, known), "online")).unionByName(click_events(of_known_users(clicks, known)))
    return log if test is None else log.unionByName(test_events(test))


def event_label() -> Column:
    """Whether an offline receipt is followed by a use within LABEL_DAYS; other events are false."""
    return F.coalesce((F.col("event_type") == "offline_receive_coupon") & (F.datediff("date2", "date") <= LABEL_DAYS), F.lit(False))


def split_events(log: DataFrame, split: Split) -> DataFrame:
    """The feature range's events, and the test range's receipts with their label but without the day of use."""
    past = log.where(within("date", split.feature)).withColumn("label", event_label())
    later = log.where(within("date", split.test) & (F.col("event_type") == "offline_receive_coupon")).withColumn("label", event_label()).withColumn("date2", F.lit(None).cast("date"))
    return past.unionByName(later)


def rows_of_split(log: DataFrame, bounds: tuple[str, str], with_label: bool) -> DataFrame:
    """Receipts of a range of days, to be joined with features: ids, t, discount, distance and maybe the label."""
    own = log.where((F.col("event_type") == "offline_receive_coupon") & within("date", bounds))
    return own.select("user_id", "merchant_id", "coupon_id", "date", "distance", "discount_name", *["label"] * with_label)


def wide(log: DataFrame) -> DataFrame:
    """The log with day numbers and flags of what an event is."""
    kind = F.col("event_type")
    return log.withColumns({
        "t": day_number(F.col("date")), "t2": day_number(F.col("date2")), "is_offline": kind.startswith("offline"), "is_coupon": kind.endswith("_coupon") & ~kind.endswith("without_coupon"), "is_buy": kind.contains("_buy_"),
    })


def discount_table(log: DataFrame) -> DataFrame:
    """One row for each discount name that occurs, with its fields; the key is the name as it stands in the log."""
    names = log.select("discount_name").dropna().distinct()
    own = names.withColumn("f", discount_struct(F.col("discount_name")))
    return own.select("discount_name", *(f"f.{c}" for c in ("is_xianshi", "is_dazhe", "is_manjian", "discount_man", "discount_jian", "discount_rate")))


def with_discount(df: DataFrame, discounts: DataFrame) -> DataFrame:
    """Left join of the discount table; Spark broadcasts it where its size allows."""
    return df.join(discounts, "discount_name", "left")


def distinct_keys(log: DataFrame, *keys: str) -> DataFrame:
    return log.select(*keys).dropna().distinct()


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...], separator: str = "_") -> DataFrame:
    return df.toDF(*(c if c in keep else f"{prefix}{separator}{c}" for c in df.columns))


def filled_by_type(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Missing numbers become 0, missing flags false, by the schema's types."""
    kinds = {c: t for c, t in df.dtypes if c not in skip}
    return df.na.fill(0, [c for c, t in kinds.items() if t in ("double", "float", "int", "bigint")]).na.fill(False, [c for c, t in kinds.items() if t == "boolean"])
