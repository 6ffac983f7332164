"""Column types and kinds of events that the whole library shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType


def _struct(**columns) -> StructType:
    return StructType([StructField(n, t()) for n, t in columns.items()])


RAW_OFFLINE = _struct(User_id=LongType, Merchant_id=LongType, Coupon_id=StringType, Discount_rate=StringType, Distance=DoubleType, Date_received=StringType, Date=StringType)
RAW_ONLINE = _struct(User_id=LongType, Merchant_id=LongType, Action=StringType, Coupon_id=StringType, Discount_rate=StringType, Date_received=StringType, Date=StringType)
RAW_TEST = StructType([f for f in RAW_OFFLINE if f.name != "Date"])

EVENTS = StructType([
    StructField("date", DateType()), StructField("date2", DateType()), StructField("event_type", StringType()), StructField("user_id", LongType()), StructField("merchant_id", LongType()),
    StructField("coupon_id", StringType()), StructField("discount_name", StringType()), StructField("distance", DoubleType()), StructField("click_count", DoubleType()),
])

DISCOUNTS = StructType([
    StructField("discount_name", StringType(), nullable=False), *(StructField(f"is_{k}", BooleanType(), nullable=False) for k in ("xianshi", "dazhe", "manjian")),
    *(StructField(f"discount_{k}", DoubleType()) for k in ("man", "jian", "rate")),
])

# fixed values: what an online row tells
CLICK, BUY, RECEIVE = "0", "1", "2"
# fixed values: names of the event kinds
OFFLINE_KINDS = ("offline_receive_coupon", "offline_buy_with_coupon", "offline_buy_without_coupon")
ONLINE_KINDS = ("online_receive_coupon", "online_buy_with_coupon", "online_buy_without_coupon", "online_click")
KINDS = OFFLINE_KINDS + ONLINE_KINDS

#: Days from receiving a coupon to using it within which a use counts.
LABEL_DAYS = 15
#: What a missing distance is filled with, one more than the largest.
NO_DISTANCE = 12


@dataclass(frozen=True)
class Split:
    """Inclusive ISO dates of the features' events, of the training rows and of the test rows."""

    name: str
    feature: tuple[str, str]
    train: tuple[str, str]
    test: tuple[str, str]
    test_has_label: bool


# fixed values: the date bounds of the two splits
VALIDATE = Split("validate", ("2016-01-01", "2016-04-30"), ("2016-03-16", "2016-04-30"), ("2016-05-16", "2016-05-31"), True)
TEST = Split("test", ("2016-01-01", "2016-06-15"), ("2016-03-16", "2016-05-31"), ("2016-07-01", "2016-07-31"), False)
# fixed values: label and feature windows of the three earlier splits
CLASSIC_LABELS = {1: ("2016-04-14", "2016-05-14"), 2: ("2016-05-15", "2016-06-15")}
CLASSIC_FEATURES = {1: ("2016-01-01", "2016-04-13"), 2: ("2016-02-01", "2016-05-14"), 3: ("2016-03-15", "2016-06-30")}
