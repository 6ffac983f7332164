"""Profiles, counts and metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import placed


#: Bytes of a value, by type; texts and what is shown as text take their own.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def _parted(name: str, kind: str) -> dict[str, Column]:
    """A value as whole number, real number or text, whichever keeps its order; the others are null."""
    x = F.col(f"`{name}`")
    whole = {"date": F.unix_date, "timestamp": F.unix_micros, "boolean": lambda c: c.cast("int")}
    if kind in whole or kind in ("tinyint", "smallint", "int", "bigint"):
        return {"whole": whole.get(kind, lambda c: c)(x).cast("long")}
    if kind in ("float", "double"):
        return {"real": x.cast("double")}
    return {"text": x if kind == "string" else F.to_json(x) if kind[:3] in ("arr", "map", "str") else x.cast("string")}


def _shown(kind: str) -> Column:
    back = {"date": F.date_from_unix_date(F.col("whole").cast("int")), "timestamp": F.timestamp_micros("whole"), "boolean": F.col("whole").cast("boolean")}
    if kind in back or kind in ("tinyint", "smallint", "int", "bigint"):
        return back.get(kind, F.col("whole")).cast("string")
    return F.col("real").cast(kind).cast("string") if kind in ("float", "double") else F.col("text")


def profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, n_rows, n_bytes, n_distinct, n_null, min_value, max_value, rarest, commonest) of each column.

    All columns' values are counted by (column, value) at once, combined before the shuffle; what is told of a column
    comes from these counts. Of several rarest or commonest values the least is given.
    """
    kinds = dict(enumerate(df.dtypes))
    none = {"whole": F.lit(None).cast("long"), "real": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    each = [F.struct(F.lit(i).alias("i"), *(v.alias(k) for k, v in {**none, **_parted(n, t)}.items())) for i, (n, t) in kinds.items()]
    counts = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").groupBy("i", "whole", "real", "text").agg(F.count(F.lit(1)).alias("n"))
    known = F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False))
    shown, width = F.lit(None).cast("string"), F.lit(0).cast("long")
    for i, (_, t) in kinds.items():
        shown, width = F.when(F.col("i") == i, _shown(t)).otherwise(shown), F.when(F.col("i") == i, F.lit(WIDTHS[t]) if t in WIDTHS else F.octet_length("text")).otherwise(width)
    order = F.struct("whole", "real", "text")
    counts = counts.select("i", "n", known.alias("known"), shown.alias("shown"), F.coalesce(width, F.lit(0)).alias("width"), F.when(known, order).alias("order"))
    by = lambda n: F.when(F.col("known"), F.struct(n, "order"))
    out = counts.groupBy("i").agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.when(F.col("known") | F.col("i").isin([i for i, (_, t) in kinds.items() if t in WIDTHS]), F.col("width")).otherwise(0)).alias("n_bytes"), F.count_if("known").alias("n_distinct"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min_by("shown", "order").alias("min_value"), F.max_by("shown", "order").alias("max_value"), F.min_by("shown", by(F.col("n"))).alias("rarest"), F.min_by("shown", by(-F.col("n"))).alias("commonest"),
    )
    names = df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in kinds.items()], "i int, column_name string, data_type string")
    zero = ("n_rows", "n_bytes", "n_distinct", "n_null")
    return names.join(out, "i", "left").select("column_name", "data_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero), "min_value", "max_value", "rarest", "commonest")


def null_audit(df: DataFrame) -> DataFrame:
    """(column_name, has_null)."""
    one = df.agg(*(F.bool_or(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("has_null")) for i, c in enumerate(df.columns)))).alias("x")).select("x.*")


def schema_catalogue(df: DataFrame) -> DataFrame:
    """(prefix, data_type, n, n_values): columns by the part of their name before the first _ and by type, and their known values."""
    one = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)))
    rows = [F.struct(F.lit(c.split("_", 1)[0]).alias("prefix"), F.lit(t).alias("data_type"), F.col(f"n{i}").alias("n")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").groupBy("prefix", "data_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("n_values"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """(place, column_name, value) of the rows of a key, all as text: rows turned into columns. Few rows are meant."""
    own = df.where(F.col(key) == F.lit(value))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*df.columns)))
    return ranked.select("place", F.explode(F.array(*cells)).alias("x")).select("place", "x.*")


def key_counts(df: DataFrame, key: str, value, by: str) -> DataFrame:
    """(by, n): how often each value of a column occurs in the rows of a key."""
    return counts_of(df.where(F.col(key) == F.lit(value)), by)


def counts_of(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def size_quantiles(df: DataFrame, key: str, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(q, value): exact, interpolated quantiles of the group sizes."""
    sizes = df.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.percentile("n", F.array(*map(F.lit, at))).alias("v")).select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("q"), "value")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n): equal bins between the least and the largest value; the largest belongs to the last bin."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    own = df.dropna(subset=[column]).crossJoin(F.broadcast(ends))  # one row
    bin_ = F.least(F.floor((F.col(column) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)) * bins), F.lit(bins - 1))
    return own.groupBy(F.coalesce(bin_, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(predicted, label_false, label_true)."""
    return df.groupBy(F.col(predicted).alias("predicted")).agg(F.count_if(~F.col(label)).alias("label_false"), F.count_if(F.col(label)).alias("label_true"))


def hash_of(*columns: str, seed: int = 0) -> Column:
    """MD5 of a seed and columns as text, which other engines have too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def first_by(df: DataFrame, k: int, order: list[Column], keys: tuple[str, ...] = (), deal: int = 64) -> DataFrame:
    """The first k rows of each key (of all rows, if none) by an order; a key's rows are dealt into parts that keep k each,
    and Spark keeps k of a part in each task, so a key of any size passes."""
    parts = df.withColumn("first_part", F.pmod(F.xxhash64(*df.columns), F.lit(deal)))
    for by in ((*keys, "first_part"), keys):
        parts = parts.withColumn("first_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("first_place") <= k).drop("first_place")
    return parts.drop("first_part")


def sample_by_key(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each key, or all where it has fewer: those whose hash with a seed is least, the same in every run."""
    return first_by(df, k, [hash_of(*df.columns, seed=seed), *map(F.col, df.columns)], (key,))


def key_coverage(a: DataFrame, b: DataFrame, column: str, k: int = 4) -> DataFrame:
    """(column_name, n_own, n_total, n_missing, miss_ratio, missing): distinct values of a and of b, those of b that a
    lacks, and k of the latter, least by hash, in that order, as text."""
    left, right = (x.select(column).dropna().distinct() for x in (a, b))
    marked = right.join(left.withColumn("known", F.lit(True)), column, "left")
    counts = marked.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("known").isNull()).alias("n_missing"))
    own = left.agg(F.count(F.lit(1)).alias("n_own"))
    shown = first_by(marked.where("known is null").select(column), k, [hash_of(column)])
    listed = shown.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(hash_of(column).alias("h"), F.col(column).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("missing"))
    # one row each
    out = own.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(listed))
    return out.select(F.lit(column).alias("column_name"), "n_own", "n_total", "n_missing", F.try_divide("n_missing", "n_total").alias("miss_ratio"), "missing")


def auc(df: DataFrame, label: str, score: str, group: str | None = None) -> DataFrame:
    """([group,] auc): area under the ROC curve, null where a class is missing. Ties share their mean rank.

    Rows are counted by score first, so a group's window holds its distinct scores, not its rows. Without a group, the
    scores get their running counts from ranges of their order, so no task sees all of them.
    """
    keys = [group] if group else []
    by = df.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    if group:
        upto = by.withColumn("upto_n", F.sum("n").over(Window.partitionBy(group).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        upto = placed(by, [F.col("s")], ("n",))
    won = upto.withColumn("won", F.col("p") * (F.col("upto_n") - F.col("n") / 2))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def mean_group_auc(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    """(mean_auc, n_groups): unweighted, over groups that have both classes."""
    return auc(df, label, score, group).agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_groups"))


def rolling_sums(df: DataFrame, order: str, value: str, width: int = 3, key: str | None = None) -> DataFrame:
    """Rows with the sum over each `width` neighbours by order; rows that have fewer go."""
    w = Window.partitionBy(*([key] if key else [])).orderBy(order).rowsBetween(1 - width, 0)
    return df.withColumns({"rolling": F.sum(value).over(w), "neighbours": F.count(value).over(w)}).where(F.col("neighbours") == width).drop("neighbours")


def rolling_apply(df: DataFrame, order: str, value: str, f: Callable[[Column], Column], width: int = 3, key: str | None = None) -> DataFrame:
    """Rows with rolling: f of the array of `width` neighbours by order, the row's own value last; rows that have fewer
    known ones go. f is made of array functions."""
    w = Window.partitionBy(*([key] if key else [])).orderBy(order).rowsBetween(1 - width, 0)
    return df.withColumn("neighbours", F.collect_list(value).over(w)).where(F.size("neighbours") == width).withColumn("rolling", f(F.col("neighbours"))).drop("neighbours")


def top_merchants_by_share(df: DataFrame, key: str = "merchant_id", share: float = 0.8, step: int = 5) -> DataFrame:
    """The keys of the smallest multiple of `step` largest groups that hold more than `share` of the rows, ties by key.

    Groups get their places and the rows up to them from ranges of the order, so no task sees all groups, nor all of
    one size.
    """
    own = placed(counts_of(df, key), [F.desc("n"), F.col(key)], ("n",))
    limit = own.agg((F.sum("n") * F.lit(share)).alias("limit"))
    most = own.crossJoin(F.broadcast(limit)).agg((F.ceil(F.min(F.when(F.col("upto_n") > F.col("limit"), F.col("place"))) / step) * step).alias("most"))
    # one row each
    return own.crossJoin(F.broadcast(most)).where(F.col("place") <= F.coalesce("most", F.lit(2**62))).select(key, "n")


def split_by_keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in a table, and the others."""
    return df.join(keys.select(key), key, "left_semi"), df.join(keys.select(key), key, "left_anti")


def side_by_side(a: DataFrame, b: DataFrame, order_a: list, order_b: list, most: int) -> DataFrame:
    """The first rows of two tables, joined by their place."""
    ranked = [x.orderBy(*o).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*o))) for x, o in ((a, order_a), (b, order_b))]
    return reduce(lambda x, y: x.join(y, "place", "full_outer"), ranked)
