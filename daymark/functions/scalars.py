"""Discounts, calendars and day numbers as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISCOUNT_FIELDS = ("discount_name", "is_xianshi", "is_dazhe", "is_manjian", "discount_man", "discount_jian", "discount_rate")

# fixed values: holidays and make-up workdays of the year as (month, day); 02-14 is both
HOLIDAYS = (
    "01-01", "01-02", "01-03", "02-01", "02-04", "02-07", "02-08", "02-09", "02-10", "02-11", "02-12", "02-13", "02-14", "02-22", "03-08", "03-12",
    "03-15", "04-01", "04-02", "04-03", "04-04", "04-30", "05-01", "05-02", "05-08", "06-01", "06-07", "06-08", "06-09", "06-10", "06-11", "06-19",
)
WORKDAYS = ("02-06", "02-14", "06-12")

DATE_FLAGS = ("is_holiday", "is_jiaban", "is_month_start", "is_month_end", *(f"is_weekday_{i}" for i in range(1, 8)))


def discount_struct(text: Column) -> Column:
    """name, kind flags, man, jian and rate of a discount: `fixed`, `man:jian`, or a rate (a percentage where over 1).

    The name of a rate is its percentage cut to whole numbers in double arithmetic, so 0.29 is named 28.
    """
    parts = F.split(text, ":")
    fixed, two = text == "fixed", F.size(parts) == 2
    man, jian = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    raw = text.try_cast("double")
    rate = F.when(raw > 1.0, raw / F.lit(100.0)).otherwise(raw)
    whole = lambda x: x.cast("long").cast("string")
    full = text.isNotNull() & ~fixed
    reduced, cut = full & two, full & ~two
    return F.struct(
        F.when(fixed, F.lit("fixed")).when(reduced, F.concat_ws(":", whole(man), whole(jian))).when(cut, whole(rate * F.lit(100.0))).alias("discount_name"),
        F.coalesce(fixed, F.lit(False)).alias("is_xianshi"), F.coalesce(cut, F.lit(False)).alias("is_dazhe"), F.coalesce(reduced, F.lit(False)).alias("is_manjian"),
        F.when(reduced, man).when(cut, F.lit(0.0)).alias("discount_man"), F.when(reduced, jian).alias("discount_jian"),
        F.when(reduced, 1 - F.try_divide(jian, man)).when(cut, rate).alias("discount_rate"),
    )


def with_discount_fields(df: DataFrame, column: str) -> DataFrame:
    """df with the seven fields of a discount column in its place."""
    kept = [c for c in df.columns if c != column]
    return df.withColumn("discount_fields", discount_struct(F.col(column))).select(*kept, "discount_fields.*")


def compact_date(text: Column) -> Column:
    """A date from yyyyMMdd; null where it is none."""
    return F.try_to_date(text, "yyyyMMdd")


def day_number(date: Column) -> Column:
    """Day of the year from 0."""
    return F.dayofyear(date) - 1


def date_of_day(day: Column, first: str = "2016-01-01") -> Column:
    return F.date_add(F.lit(first).cast("date"), day)


def date_fields(date: Column) -> dict[str, Column]:
    """name and eleven flags of a date; all null for a null date."""
    day = F.date_format(date, "MM-dd")
    flags = {"is_holiday": day.isin(*HOLIDAYS), "is_jiaban": day.isin(*WORKDAYS), "is_month_start": F.dayofmonth(date) == 1, "is_month_end": date == F.last_day(date)}
    flags |= {f"is_weekday_{i + 1}": F.weekday(date) == i for i in range(7)}
    said = [F.when(flags[f], F.lit(t)).otherwise("") for f, t in (("is_holiday", "吉"), ("is_jiaban", "班"), ("is_month_start", "月初"), ("is_month_end", "月末"))]
    name = F.when(date.isNotNull(), F.concat(*said, F.lit("周"), (F.weekday(date) + 1).cast("string")))
    return {"name": name, **flags}


def with_date_fields(df: DataFrame, column: str) -> DataFrame:
    """df with the fields of one of its date columns, named column_field."""
    return df.withColumns({f"{column}_{k}": v for k, v in date_fields(F.col(column)).items()})


def with_day_parts(df: DataFrame, column: str) -> DataFrame:
    """date_dayofweek (Monday is 0) and date_dayofmonth of a date column."""
    return df.withColumns({"date_dayofweek": F.weekday(column), "date_dayofmonth": F.dayofmonth(column)})


def clipped(x: Column, low: int = 0, high: int = 365) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def hash_bucket(n: int, *columns: str) -> Column:
    """A bucket from 0 to n - 1 by the first 32 bits of the MD5 of the columns as text, which other engines have too."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n
