"""Every operator as a named query over the purchase log derived from the star schema."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import boosting, learning, reports, selection, shaping, stats
from ..operators.partitions import by_key
from ..operators.ranking import placed
from ..schema import EVENTS, Split
from ..sources import files
from ..sources.files import as_views, kept, read_table, session_folder, stored, stored_by
from ..sources.orders import YEAR, order_lines
from . import classic, merging
from .definitions import KEYS, features
from .language import STEPS, Aggregate, Distinct, Features, Filter, Value, parse
from .snapshots import Ranges, evaluate, plain_name, prepared

#: Day ranges for the splits of the derived year.
SPLIT = Split("derived", ("1996-01-01", "1996-08-31"), ("1996-05-01", "1996-08-31"), ("1996-09-15", "1996-10-31"), True)
LABELS, FEATURES = ("1996-08-01", "1996-09-30"), ("1996-01-01", "1996-07-31")


#: The tables that the log is derived from.
INPUTS = ("orders", "lineitem", "part")


class Log:
    """The derived tables of one folder. The lines and the event log are written once a session; queries read those."""

    name = "events"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def lines(self) -> DataFrame:
        return stored(self.spark, self.folder, "lines", lambda: order_lines(self.spark, self.folder, in_parts=self.parts), INPUTS)

    @property
    def offline(self) -> DataFrame:
        return shaping.labelled(self.lines.where(~F.col("online")).drop("online", "click", "line", "order_id"))

    @property
    def online_coupon(self) -> DataFrame:
        rows = self.lines.where(F.col("online") & ~F.col("click")).drop("online", "click", "line", "order_id", "distance")
        return scalars.with_discount_fields(rows, "discount")

    @property
    def clicks(self) -> DataFrame:
        return shaping.click_counts(self.lines.where("click"))

    @property
    def prepared(self) -> DataFrame:
        """The event log with day numbers and discount fields."""
        return stored(self.spark, self.folder, "events", lambda: prepared(shaping.event_log(self.offline, self.online_coupon, self.clicks, parts=self.parts)), INPUTS)

    @property
    def by_user(self) -> DataFrame:
        """The same log in buckets by user, unless one user has a large part of all events. Merchants and coupons are few
        and may have; their events are put together by day before they are shuffled instead."""
        return stored_by(self.spark, self.folder, self.name, lambda: self.prepared, INPUTS, "user_id", "t")

    def of(self, keys: tuple[str, ...]) -> DataFrame:
        """The log in the layout that suits features of keys."""
        return self.by_user if "user_id" in keys else self.prepared

    @property
    def parts(self) -> int:
        """In how many parts wide rows derived from the log are shuffled."""
        return files.parts_of(self.spark, self.folder, INPUTS)

    def evaluated(self, keys: tuple[str, ...], wanted: Features, receipts: Ranges | None = None) -> DataFrame:
        """Features of keys from the layout that suits them: buckets are parts already."""
        events = self.of(keys)
        whole = "user_id" in keys and files.in_buckets(self.spark, self.folder, self.name, "user_id")
        return evaluate(events, keys, wanted, plain=True, parts=self.parts, receipts=receipts, bucketed=whole)

    def entity(self, name: str, only=None, receipts: Ranges | None = None) -> DataFrame:
        wanted = features(name)
        return self.evaluated(KEYS[name], wanted if only is None else wanted.only(only), receipts)

    @property
    def events(self) -> DataFrame:
        return self.prepared.select(*EVENTS.names)

    def raw(self, name: str) -> str:
        """Where the lines are as raw files with a head line, missing values as null: offline, online or test."""
        made = {
            "offline": lambda: shaping.raw_offline(self.lines.where(~F.col("online"))), "online": lambda: shaping.raw_online(self.lines.where("online")),
            "test": lambda: shaping.raw_test(self.lines.where(~F.col("online") & shaping.within("date_received", SPLIT.test))),
        }
        return files.stored_at(self.spark, self.folder, f"raw_{name}", lambda path: files.write_typed_csv(made[name](), path), INPUTS)

    def csv(self, name: str, df: DataFrame) -> str:
        """Where a table of this log is as CSV with a head line."""
        return files.stored_at(self.spark, self.folder, f"csv_{name}", lambda path: files.write_typed_csv(df, path), INPUTS)

    @property
    def dates(self) -> DataFrame:
        """The days on which anything happens."""
        return self.prepared.select(F.col("date").alias("day")).distinct()

    @property
    def discounts(self) -> DataFrame:
        return shaping.discount_table(self.prepared)


class Past(Log):
    """The log of a split: the feature range's events, and the test range's receipts without the day of use."""

    name = "past"

    @property
    def prepared(self) -> DataFrame:
        return stored(self.spark, self.folder, "past", lambda: prepared_split(super(Past, self).prepared), INPUTS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, as sums depend on their order; halves are told by the first ten digits."""
    return df.selectExpr(*(f"CAST(round(CAST(`{c}` AS DECIMAL(38,10)), {digits}) AS DOUBLE) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes))


def entity(name: str, only=None) -> Callable:
    return lambda spark, folder: rounded(Log(spark, folder).entity(name, only))


def window_query(name: str) -> Callable:
    return entity("merchant", [f"{name}.offline_receive_coupon.count"])


#: A short text for each operator of the language, by user or merchant.
OPERATORS = {
    "op_man200": ("user_id", "recent.offline_receive_coupon.man200.count"),
    "op_timedelta": ("merchant_id", "recent.offline_buy_with_coupon.timedelta.mean\nrecent.offline_buy_with_coupon.timedelta.max"),
    "op_deltanow": ("user_id", "future.offline_receive_coupon.deltanow.min"),
    "op_three_states": ("merchant_id", "recent.offline_buy_with_coupon.distance.min\nrecent.offline_buy_with_coupon.distance.max\nrecent.offline_buy_with_coupon.distance.mean"),
    "op_unique": ("merchant_id", "recent.offline.unique_user.count\nrecent.offline.unique_coupon.count\nhistory.offline.unique_merchant.count"),
    "op_hot": ("merchant_id", "recent.offline_buy_without_coupon.unique_hotuser.count\nlongago.offline.unique_hotcoupon.count\nlongago.offline.unique_hotuser.count"),
    "op_div": ("merchant_id", "recent.offline_buy_with_coupon.count\nrecent.offline_receive_coupon.count\nrecent(offline_buy_with_coupon.count / offline_receive_coupon.count)"),
    "op_sub": ("merchant_id", "recent.offline_buy_with_coupon.count\nrecent.offline_receive_coupon.count\nrecent(offline_receive_coupon.count - offline_buy_with_coupon.count)"),
    "op_kinds": ("user_id", "longago.online.count\nlongago.offline.count\nlongago.online_click.count\nlongago.online_receive_coupon.count\nlongago.online_buy_with_coupon.count\nlongago.online_buy_without_coupon.count\nlongago.offline_buy_without_coupon.count"),
    "op_discount_rate": ("user_id", "longago.offline_receive_coupon.discount_rate.min\nlongago.offline_receive_coupon.discount_rate.max\nlongago.offline_receive_coupon.discount_rate.mean"),
    "clip_boundary": ("merchant_id", "future.offline.count\ntoday.offline.count\nrecent.offline.count\nhistory.offline.count\nlongago.offline.count"),
}


#: Steps of a caller's own beside the library's: far uses, clicks, active days, sums and deviations.
OWN_STEPS = STEPS.plus(
    Filter("far", "distance >= 5"), Value("clicks", "click_count"), Distinct("unique_day", "date"), Aggregate("sum", "{s}", {"s": ("sum({x})", "sum")}, "{n} * t"),
    Aggregate("std", "CASE WHEN {n} > 1 THEN sqrt(greatest(({q} - {s} * {s} / {n}) / ({n} - 1), 0D)) END", {"s": ("sum({x})", "sum"), "q": ("sum({x} * {x})", "sum")}, "0D"),
)
OWN_TEXT = """
longago.offline_buy_with_coupon.far.count
longago.offline_buy_with_coupon.count
longago(offline_buy_with_coupon.far.count / offline_buy_with_coupon.count)
recent.offline.unique_day.count
recent.offline_receive_coupon.discount_rate.std
longago.online_click.clicks.sum
recent.offline_receive_coupon.deltanow.sum
"""


def registered(spark, folder):
    """Features whose steps aren't the library's, by user."""
    return rounded(Log(spark, folder).evaluated(("user_id",), parse(OWN_TEXT, OWN_STEPS)))


def operator_query(name: str) -> Callable:
    key, text = OPERATORS[name]
    return lambda spark, folder: rounded(Log(spark, folder).evaluated((key,), parse(text)))


def merged_of(past: Past, ranges: tuple[tuple[str, str], ...], only: Callable[[str], list[str] | None] = lambda e: None) -> DataFrame:
    """Receipts of ranges of days with features of their five entities, which are made for days with a receipt only."""
    days = tuple(tuple((dt.date.fromisoformat(d) - dt.date(YEAR, 1, 1)).days for d in r) for r in ranges)
    by = {e: past.entity(e, only(e), days) for e in merging.ORDER}
    rows = reduce(DataFrame.unionByName, (shaping.rows_of_split(past.prepared, r, True) for r in ranges))
    return merging.merged(rows, shaping.discount_table(past.prepared), by, separator="_", parts=past.parts)


def merged_rows(spark, folder) -> DataFrame:
    """Receipts of the training range with every feature of their five entities."""
    return merged_of(Past(spark, folder), (SPLIT.train,))


def dataset_of(spark, folder) -> learning.Dataset:
    """Receipts of the training and the test range with the recent features of their five entities, written once."""

    def rows() -> DataFrame:
        recent = lambda e: [n for n in features(e).names if n.startswith("recent")] or None
        return merged_of(Past(spark, folder), (SPLIT.train, SPLIT.test), recent).withColumn("date", scalars.date_of_day(F.col("date"), f"{YEAR}-01-01"))

    own = stored(spark, folder, "rows", rows, INPUTS)
    return learning.dataset(own.where(shaping.within("date", SPLIT.train)), own.where(shaping.within("date", SPLIT.test)), share=0.2)


def held_out(spark, folder):
    data = dataset_of(spark, folder)
    ids = ("user_id", "merchant_id", "coupon_id", "date", "label")
    return reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("part"), *ids) for n, df in (("train", data.train), ("validate", data.validate), ("test", data.test))))


def submit(spark, folder):
    """Trains with early stopping, saves the model, and foretells the test rows with the loaded model."""
    data, path = dataset_of(spark, folder), session_folder(spark, "model")
    learning.save_model(learning.train_trees(data.train, data.inputs, rounds=5, depth=4, validate=data.validate), path)
    return learning.submission(learning.predict(learning.load_model(path), data.test, data.inputs))


def submit_checks(spark, folder):
    return checks_of(submit(spark, folder))


def submit_by_leaf(spark, folder):
    """The same with trees that grow by leaf: 16 leaves of depth 8 at most, a fifth of the inputs each."""
    data, path = dataset_of(spark, folder), session_folder(spark, "model")
    settings = boosting.Settings(trees=6, leaves=16, depth=8, feature_share=0.2, patience=4)
    boosting.save(boosting.train(data.train, data.inputs, validate=data.validate, settings=settings), spark, path)
    return learning.submission(boosting.predict(boosting.load(spark, path), data.test))


def checks_of(out: DataFrame) -> DataFrame:
    """(n, n_bad, better_than_chance) of a submission: rows, probabilities out of range, and an AUC over 0.5."""
    out = kept(out, "submission")
    ranges = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob").isNull() | ~F.col("prob").between(0, 1)).alias("n_bad"))
    return ranges.crossJoin(reports.auc(out, "label", "prob").select((F.col("auc") > 0.5).alias("better_than_chance")))


def prepared_split(log: DataFrame) -> DataFrame:
    """The split's events, whose test receipts no longer tell the day of use."""
    return shaping.split_events(log, SPLIT).withColumn("timedelta", F.when(F.col("date2").isNotNull(), F.col("timedelta")))


def feat_merged(spark, folder):
    return rounded(merged_rows(spark, folder).drop("discount_name"))


def learning_rows(spark, folder) -> tuple[DataFrame, list[str]]:
    own = Log(spark, folder).offline.where("coupon_id is not null")
    inputs = ["distance", "discount_rate", "discount_man", "weekday", "month"]
    rows = own.withColumns({"weekday": F.weekday("date_received"), "month": F.month("date_received")}).select("user_id", "merchant_id", "coupon_id", "date_received", "label", *inputs)
    return rows.na.fill(0, inputs), inputs


def made_scores(rows: DataFrame) -> DataFrame:
    """A score table with merchants as features: six shares and means of each."""
    made = (F.avg(F.col("discount_rate")), F.avg(F.col("user_id") % 7), F.avg(F.col("coupon_id").isNotNull().cast("double")), F.avg(F.col("discount_man")), F.avg(F.col("date").isNotNull().cast("double")), F.count(F.lit(1)).cast("double"))
    own = rows.groupBy("merchant_id").agg(*(m.alias(c) for m, c in zip(made, selection.SCORES, strict=True)))
    return own.select((F.col("merchant_id") % 4).cast("string").alias("cluster"), F.concat(F.lit("f"), F.col("merchant_id").cast("string")).alias("feature"), *selection.SCORES)


def selector(spark, folder):
    """Levels from given scores: merchants offline as clusters, those chosen and the others by their online rows."""
    log = Log(spark, folder)
    clusters, later = made_scores(log.offline), made_scores(log.online_coupon)
    chosen = selection.cluster_choice(clusters)
    return selection.feature_levels(later.join(chosen, "feature", "left_semi"), later.join(chosen, "feature", "left_anti"), chosen, clusters.select("feature"))


def gbt_score(spark, folder):
    rows, inputs = learning_rows(spark, folder)
    train, check = learning.hold_out(rows, 0.2, "user_id", "coupon_id", "date_received")
    model = learning.train_trees(train, inputs, rounds=5, depth=3)
    return learning.predict(model, check, inputs).select("user_id", "coupon_id", "date_received", "label", "prob")


def pca2(spark, folder):
    rows, inputs = learning_rows(spark, folder)
    return rounded(learning.components(rows, inputs, 2, whiten=True).select("user_id", "coupon_id", "pc_0", "pc_1"))


def scaled_pca(spark, folder):
    rows, inputs = learning_rows(spark, folder)
    return rounded(learning.components(rows, inputs, 2, scale=True).select("user_id", "coupon_id", "pc_0", "pc_1"))


def lda1(spark, folder):
    rows, inputs = learning_rows(spark, folder)
    return rounded(learning.discriminant(rows, inputs, "label")[1].select("user_id", "coupon_id", "label", "ld"))


def scored_rows(log: Log) -> DataFrame:
    """Receipts with a made-up score that has ties."""
    return log.offline.where("coupon_id is not null").select("merchant_id", "label", ((F.col("user_id") % 20) / 20.0 + F.coalesce(F.col("discount_rate"), F.lit(0.0)) / 2).alias("prob"))


def discount_sample(spark, folder):
    rows = Log(spark, folder).lines.select("discount").distinct()
    fixed = spark.createDataFrame([(x,) for x in ("fixed", "150:20", "0.9", "95", "0.29", "0.58", "1", "200:50", None)], "discount string")
    return rounded(scalars.with_discount_fields(rows.unionByName(fixed).distinct().withColumn("text", F.col("discount")), "discount"))


def union_all(spark, folder):
    log = Log(spark, folder)
    both = log.offline.select("user_id", "merchant_id").unionByName(log.online_coupon.select("user_id", "merchant_id"))
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def inner_discount(spark, folder):
    log = Log(spark, folder)
    events = log.events
    return rounded(events.join(shaping.discount_table(events), "discount_name").groupBy("discount_name").agg(F.count(F.lit(1)).alias("n"), F.first("discount_rate").alias("discount_rate")))


def left_discount_sql(spark, folder):
    events = Log(spark, folder).events
    as_views(daymark_events=events, daymark_discounts=shaping.discount_table(events))
    return rounded(spark.sql("select e.event_type, count(*) n, count(d.discount_rate) n_rate, sum(d.discount_rate) total from daymark_events e left join daymark_discounts d on e.discount_name = d.discount_name group by e.event_type"))


def big_merchants(spark, folder):
    log = Log(spark, folder)
    own, _ = shaping_split = reports.split_by_keys(log.offline, reports.top_merchants_by_share(log.offline), "merchant_id")
    return shaping_split[0].groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"))


def receive_days(spark, folder):
    rows = Log(spark, folder).events.where("event_type = 'offline_receive_coupon'")
    return rows.select("merchant_id", "date").distinct()


def receive_days_by_function(spark, folder):
    """The days of each merchant's receipts, from all its receipts in order."""
    rows = Log(spark, folder).events.where("event_type = 'offline_receive_coupon'").select("merchant_id", "date")

    def days(key, batches):
        last = None
        for b in batches:
            own = list(dict.fromkeys(b.column("date").to_pylist()))
            new = [d for d in own if d != last]
            last = own[-1]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(new), pa.int64()), pa.array(new, pa.date32())], names=["merchant_id", "date"])

    return by_key(rows, "merchant_id", days, "merchant_id long, date date", ("date",))


def longest_gaps(spark, folder):
    """(merchant_id, n, longest): receipts of each merchant and the most days between two that follow each other, by a
    function that sees a merchant's receipts in order, a batch at a time."""
    rows = Log(spark, folder).events.where("event_type = 'offline_receive_coupon'").select("merchant_id", "date")

    def gaps(key, batches):
        last, n, longest = None, 0, None
        for b in batches:
            days = b.column("date").cast(pa.int32()).to_numpy()
            steps = np.diff(days, prepend=days[0] if last is None else last)[last is None :]
            longest = max([longest or 0, int(steps.max())]) if len(steps) else longest
            last, n = days[-1], n + len(days)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([n], pa.int64()), pa.array([longest], pa.int32())], names=["merchant_id", "n", "longest"])

    return by_key(rows, "merchant_id", gaps, "merchant_id long, n long, longest int", ("date",))


def merged_classic(spark, folder):
    """Label rows with every statistic of the feature range's users, merchants, coupons, discounts and distances."""
    log = Log(spark, folder)
    past, clicks = shaping.feature_rows(log.offline, FEATURES), shaping.feature_rows(log.clicks, FEATURES)
    online = shaping.feature_rows(log.online_coupon, FEATURES)
    rows = shaping.label_rows(log.offline, LABELS).select("user_id", "merchant_id", "coupon_id", "discount_name", "date_received", "distance", "label")
    entities = classic.user_features(past, clicks, online), classic.merchant_features(past), classic.coupon_features(past), classic.discount_features(past, online), classic.distance_features(past)
    return rounded(classic.merged_classic(rows, *entities, keep_ids=True))


def q(f: Callable[[Log], DataFrame]) -> Callable:
    return lambda spark, folder: rounded(f(Log(spark, folder)))


def row_numbers(log: Log) -> DataFrame:
    return log.lines.select("order_id", "line").withColumn("row", F.row_number().over(Window.partitionBy("order_id").orderBy("line")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # the flagship: receipts, uses and their ratio of each user, as of each day
    "recent_conversion": entity("user", ["recent.offline_buy_with_coupon.count", "recent.offline_receive_coupon.count", "recent(offline_buy_with_coupon.count/offline_receive_coupon.count)"]),
    # sources, projections, filters, events
    "scan_offline": q(lambda g: g.offline),
    "scan_online_coupon": q(lambda g: g.online_coupon),
    "raw_offline": q(lambda g: shaping.typed_offline(files.read_offline(g.spark, g.raw("offline")))),
    "raw_online_coupon": q(lambda g: shaping.typed_online_coupon(shaping.split_clicks(files.read_online(g.spark, g.raw("online")))[1])),
    "raw_clicks": q(lambda g: shaping.typed_clicks(shaping.split_clicks(files.read_online(g.spark, g.raw("online")))[0])),
    "raw_test": q(lambda g: shaping.typed_test(files.read_test(g.spark, g.raw("test")))),
    "raw_test_events": q(lambda g: shaping.test_events(shaping.typed_test(files.read_test(g.spark, g.raw("test"))))),
    "events_csv": q(lambda g: files.read_events(g.spark, g.csv("events", g.events))),
    "discounts_csv": q(lambda g: files.read_discounts(g.spark, g.csv("discounts", g.discounts))),
    "click_preagg": q(lambda g: g.clicks),
    "parse_discount": discount_sample,
    "discount_dim": q(lambda g: g.discounts),
    "select_label": q(lambda g: shaping.label_rows(g.offline, LABELS)),
    "select_feature": q(lambda g: shaping.feature_rows(g.offline, FEATURES)),
    "select_received": q(lambda g: shaping.received_coupons(g.offline).select("user_id", "coupon_id", "date_received", "date")),
    "select_buy_with": q(lambda g: shaping.used_coupons(g.offline).select("user_id", "coupon_id", "date_received", "date")),
    "select_buy_without": q(lambda g: shaping.bought_without(g.offline).select("user_id", "merchant_id", "date")),
    "event_type_case": q(lambda g: g.offline.groupBy(shaping.coupon_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))),
    "event_fanout": q(lambda g: shaping.coupon_events(g.offline, "offline").drop("click_count")),
    "events_union": q(lambda g: g.events),
    "events_label": q(lambda g: g.events.withColumn("label", shaping.event_label()).groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"))),
    "events_split": q(lambda g: shaping.split_events(g.events, SPLIT).select("date", "date2", "event_type", "user_id", "merchant_id", "coupon_id", "label")),
    "test_events": q(lambda g: shaping.test_events(g.offline.where("coupon_id is not null").drop("date", "label")).select("date", "date2", "event_type", "user_id", "coupon_id")),
    "wide_flags": q(lambda g: shaping.wide(g.events).groupBy("event_type", "is_offline", "is_coupon", "is_buy").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("sum_t"), F.sum("t2").alias("sum_t2"))),
    "dropna_keys": q(lambda g: g.events.dropna(subset=["user_id", "coupon_id"]).select("user_id", "coupon_id", "event_type", "date")),
    "fill_by_type": q(lambda g: shaping.filled_by_type(g.offline.select("user_id", "distance", "discount_jian", "is_manjian", "label"))),
    "predict_rows": q(lambda g: shaping.rows_to_predict(g.offline).select("user_id", "coupon_id", "date_received", "date_received_name", "date_received_is_holiday", "date_received_is_weekday_7")),
    # joins
    "left_discount": q(lambda g: shaping.with_discount(g.events, g.discounts).select("event_type", "user_id", "date", "discount_name", "discount_rate", "discount_man")),
    "left_discount_sql": left_discount_sql,
    "inner_discount": inner_discount,
    "semi_known_users": q(lambda g: shaping.of_known_users(g.online_coupon, g.offline).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))),
    "outer_align": q(lambda g: stats.aligned([stats.to_users(shaping.received_coupons(g.offline), "coupon_id").select("coupon_id", F.col("user_count").alias("received")), stats.to_users(shaping.used_coupons(g.offline), "coupon_id").select("coupon_id", F.col("user_count").alias("used"))], "coupon_id")),
    "id_coverage": q(lambda g: reports.key_coverage(g.offline, g.online_coupon, "user_id").unionByName(reports.key_coverage(g.offline, g.online_coupon, "coupon_id"))),
    "id_difference": q(lambda g: g.online_coupon.select("user_id").subtract(g.offline.select("user_id"))),
    "big_merchant_split": big_merchants,
    "feat_merged": feat_merged,
    # statistics
    "top20_active": q(lambda g: stats.most_active(g.offline, "date")),
    "user_merchant_stats": q(lambda g: stats.to_merchants(g.offline)),
    "to_user_stats_merchant": q(lambda g: stats.to_users(g.offline, "merchant_id")),
    "to_user_stats_coupon": q(lambda g: stats.to_users(g.offline, "coupon_id")),
    "to_user_stats_discount": q(lambda g: stats.to_users(g.offline, "discount_name")),
    "to_user_stats_distance": q(lambda g: stats.to_users(g.offline, "distance")),
    "discount_stats": q(lambda g: stats.discounts(g.offline, "merchant_id", with_kinds=True)),
    "distance_stats": q(lambda g: stats.distances(g.offline, "merchant_id")),
    "date_any": q(lambda g: stats.any_date(g.offline, "date", "user_id")),
    "hold_days_stats": q(lambda g: stats.hold_days(g.offline, "user_id")),
    "click_stats": q(lambda g: stats.click_spread(g.clicks)),
    "transfer_rate": q(lambda g: classic.merchant_features(g.offline).select("merchant_id", "merchant_offline_received_coupon_coupon_count", "merchant_offline_buy_with_coupon_coupon_count", "merchant_offline_transfer_rate_received_coupon_coupon_count_to_buy_with_coupon_coupon_count")),
    "mode_tie": q(lambda g: g.offline.groupBy("merchant_id").agg(stats.most_frequent(F.col("distance")).alias("distance"), stats.most_frequent(F.col("discount_name")).alias("discount_name"))),
    "classic_user": q(lambda g: classic.user_features(g.offline, g.clicks, g.online_coupon)),
    "classic_merchant": q(lambda g: classic.merchant_features(g.offline)),
    "classic_coupon": q(lambda g: classic.coupon_features(g.offline)),
    "classic_distance": q(lambda g: classic.distance_features(g.offline)),
    "classic_discount": q(lambda g: classic.discount_features(g.offline, g.online_coupon)),
    "classic_merged": merged_classic,
    "key_distinct_single": q(lambda g: shaping.distinct_keys(g.events, "coupon_id")),
    "key_distinct_multi": q(lambda g: shaping.distinct_keys(g.events, "user_id", "coupon_id")),
    "merchant_places": q(lambda g: placed(reports.counts_of(g.offline, "merchant_id"), [F.desc("n"), F.col("merchant_id")], ("n",))),
    "sample_receipts": q(lambda g: reports.sample_by_key(g.offline.where("coupon_id is not null").select("merchant_id", "user_id", "coupon_id", "date_received"), "merchant_id", 3, seed=7)),
    "lookup_user": q(lambda g: reports.lookup(g.events.select("user_id", "date", "event_type", "merchant_id", "coupon_id", "distance"), "user_id", 7)),
    "lookup_counts": q(lambda g: reports.key_counts(g.events, "merchant_id", 1, "event_type")),
    "quantiles": q(lambda g: reports.size_quantiles(g.offline, "coupon_id")),
    "value_counts": q(lambda g: reports.counts_of(g.offline, "discount_name")),
    "histogram": q(lambda g: reports.histogram(g.offline, "discount_rate")),
    "profile_table": q(lambda g: reports.profile(g.offline.select("user_id", "coupon_id", "distance", "date", "discount_name"))),
    "profile_events": lambda spark, folder: reports.profile(read_table(spark, folder, "events")),
    "null_audit": q(lambda g: reports.null_audit(g.offline)),
    "schema_catalogue": q(lambda g: reports.schema_catalogue(g.offline)),
    "confusion": q(lambda g: reports.confusion(scored_rows(g).withColumn("guess", F.col("prob") > 0.8), "label", "guess")),
    # windows and the language
    **{f"w_{w}": window_query(w) for w in ("future", "today")},
    **{f"w_{w}": entity("merchant", [f"{w}.offline_receive_coupon.count", f"{w}.offline_buy_with_coupon.count"]) for w in ("recent", "history", "longago")},
    **{name: operator_query(name) for name in OPERATORS},
    "op_registered": registered,
    **{f"feat_{e}": entity(e) for e in KEYS},
    "rolling3_sum": q(lambda g: reports.rolling_sums(g.events.groupBy("merchant_id", "date").agg(F.count(F.lit(1)).alias("n")), "date", "n", 3, "merchant_id")),
    "rolling3_median": q(lambda g: reports.rolling_apply(g.events.groupBy("merchant_id", "date").agg(F.count(F.lit(1)).alias("n")), "date", "n", lambda a: F.element_at(F.sort_array(a), 2), 3, "merchant_id")),
    # scalars
    "date_vector": q(lambda g: scalars.with_date_fields(g.dates, "day")),
    "day_ordinal": q(lambda g: g.dates.select("day", scalars.day_number(F.col("day")).alias("t"), scalars.date_of_day(scalars.day_number(F.col("day")), "1996-01-01").alias("back"))),
    "date_parts": q(lambda g: scalars.with_day_parts(g.dates, "day")),
    "date_format": q(lambda g: g.dates.select("day", F.date_format("day", "yyyyMMdd").alias("text"), scalars.compact_date(F.date_format("day", "yyyyMMdd")).alias("back"))),
    "hash_partition": q(lambda g: g.offline.groupBy(scalars.hash_bucket(8, "user_id").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))),
    # order, limits, sets
    "topk_merchant": q(lambda g: reports.counts_of(g.offline, "merchant_id").orderBy(F.desc("n"), "merchant_id").limit(10)),
    "row_number": q(row_numbers),
    "union_all": union_all,
    "side_by_side": q(lambda g: reports.side_by_side(reports.counts_of(g.offline, "merchant_id"), reports.counts_of(g.online_coupon, "merchant_id").toDF("other_id", "m"), [F.desc("n"), F.col("merchant_id")], [F.desc("m"), F.col("other_id")], 5)),
    "multi_key_sort": q(lambda g: g.offline.select("user_id", "merchant_id", "date_received").orderBy("user_id", "merchant_id", F.desc("date_received"))),
    # metrics and learning
    "auc_global": q(lambda g: reports.auc(scored_rows(g), "label", "prob")),
    "auc_per_group": q(lambda g: reports.auc(scored_rows(g), "label", "prob", "merchant_id")),
    "mean_group_auc": q(lambda g: reports.mean_group_auc(scored_rows(g), "label", "prob", "merchant_id")),
    "error_slices": q(lambda g: scored_rows(g).where((F.col("prob") > 0.8) & ~F.col("label")).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"))),
    "feature_selection_sigma": q(lambda g: learning.by_deviation(reports.counts_of(g.offline, "merchant_id"), "n")),
    "selector": selector,
    "gbt_score": gbt_score,
    "held_out": held_out,
    "submit": submit,
    "submit_checks": submit_checks,
    "submit_by_leaf_checks": lambda spark, folder: checks_of(submit_by_leaf(spark, folder)),
    "pca2": pca2,
    "scaled_pca": scaled_pca,
    "lda1": lda1,
    # functions over parts
    "receive_days_per_merchant": receive_days,
    "receive_days_by_function": receive_days_by_function,
    "longest_gaps_by_function": longest_gaps,
    # the generic event table
    "events_by_day": lambda spark, folder: rounded(read_table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4),
}

