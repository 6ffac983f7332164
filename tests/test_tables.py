"""Sources, scalar functions, statistics and metrics on hand-made rows, and some queries against their SQL."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from daymark.functions import scalars
from daymark.operators import learning, reports, selection, stats
from daymark.operators.partitions import by_sequence
from daymark.plans import oracles, queries
from daymark.sources import files
from daymark.streaming.ingest import daily_counts, event_stream

SMALL = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events"


def test_discounts(spark):
    texts = [None, "fixed", "150:20", "0.9", "95", "0.29", "0.58"]
    got = {r.text: r for r in scalars.with_discount_fields(spark.createDataFrame([(t,) for t in texts], "discount string").withColumn("text", F.col("discount")), "discount").collect()}
    assert (got[None].discount_name, got[None].is_xianshi, got[None].is_dazhe, got[None].is_manjian, got[None].discount_rate) == (None, False, False, False, None)
    assert (got["fixed"].discount_name, got["fixed"].is_xianshi, got["fixed"].discount_man) == ("fixed", True, None)
    assert (got["150:20"].is_manjian, got["150:20"].discount_man, got["150:20"].discount_jian) == (True, 150, 20) and got["150:20"].discount_rate == 1 - 20 / 150
    assert (got["0.9"].discount_name, got["0.9"].is_dazhe, got["0.9"].discount_man, got["0.9"].discount_jian) == ("90", True, 0, None)
    assert got["95"].discount_rate == 0.95 and got["0.29"].discount_name == "28" and got["0.58"].discount_name == "57"


def test_calendar(spark):
    days = spark.createDataFrame([(dt.date(2016, m, d),) for m, d in ((1, 1), (2, 14), (2, 29), (6, 12))] + [(None,)], "day date")
    got = {r.day: r for r in scalars.with_date_fields(days, "day").collect()}
    names = {k and (k.month, k.day): r.day_name for k, r in got.items()}
    assert names == {(1, 1): "吉月初周5", (2, 14): "吉班周7", (2, 29): "月末周1", (6, 12): "班周7", None: None}
    assert got[dt.date(2016, 2, 14)].day_is_holiday and got[dt.date(2016, 2, 14)].day_is_jiaban and all(v is None for v in got[None])


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "off.csv").write_text("User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date\n1,2,null,null,0,null,20160305\n1,2,7,150:20,null,20160301,null\n")
    rows = files.read_offline(spark, f"{tmp_path}/off.csv").collect()
    assert rows[0].Coupon_id is None and rows[0].Distance == 0 and rows[1].Date is None and rows[1].Discount_rate == "150:20"
    (tmp_path / "bad.csv").write_text("User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date\nx,2,null,null,0,null,20160305\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_offline(spark, f"{tmp_path}/bad.csv").collect()
    files.write_headless_csv(spark.createDataFrame([(1, 0.5)], "a int, b double"), f"{tmp_path}/out")
    files.write_headless_csv(spark.createDataFrame([(2, 0.25)], "a int, b double"), f"{tmp_path}/out", append=True)
    assert {tuple(r) for r in files.read_headless_csv(spark, f"{tmp_path}/out", "a int, b double").collect()} == {(1, 0.5), (2, 0.25)}


def test_mode_and_deviation(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, 2.0), (2, 5.0), (None, 1.0)], "k long, distance double")
    got = {r.k: r for r in stats.distances(rows, "k").collect()}
    assert set(got) == {1, 2} and got[1].distance_most_freq == 1 and got[2].distance_std is None


def test_active_fifth(spark):
    rows = spark.createDataFrame([(u, dt.date(2016, 1, d)) for u, d in ((1, 9), (2, 9), (3, 9), (4, 8), (5, 1), (6, 1), (7, 1), (8, 1), (9, 1))] + [(10, None)], "user_id long, date date")
    assert {r.user_id for r in stats.most_active(rows, "date").where("is_active").collect()} == {1, 2} and stats.most_active(rows, "date").count() == 10


def test_auc_with_ties_and_single_classes(spark):
    rows = spark.createDataFrame([("A", True, 0.9), ("A", False, 0.1), ("B", False, 0.2), ("B", False, 0.3), ("C", True, 0.5), ("C", False, 0.5)], "g string, label boolean, p double")
    assert {r.g: r.auc for r in reports.auc(rows, "label", "p", "g").collect()} == {"A": 1.0, "B": None, "C": 0.5}
    assert tuple(reports.mean_group_auc(rows, "label", "p", "g").first()) == (0.75, 2)
    pairs = [(x.p > y.p) + 0.5 * (x.p == y.p) for x in rows.collect() if x.label for y in rows.collect() if not y.label]
    assert math.isclose(reports.auc(rows, "label", "p").first().auc, sum(pairs) / len(pairs))


def test_largest_groups_by_share(spark):
    sizes = {"a": 9, "b": 7, "c": 3, "d": 3, "e": 3, "f": 3, "g": 1, "h": 1}
    rows = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)] + [(None,)], "merchant_id string")
    ranked = sorted(sizes, key=lambda k: (-sizes[k], k))
    for share in (0.0, 0.2, 0.3, 0.5, 0.55, 0.8, 0.95, 1.0):
        for step in (1, 2, 5):
            places = [i + 1 for i in range(8) if sum(sizes[k] for k in ranked[: i + 1]) > 30 * share]
            most = -(-places[0] // step) * step if places else 8
            assert {r.merchant_id for r in reports.top_merchants_by_share(rows, share=share, step=step).collect()} == set(ranked[:most]), (share, step)
    assert reports.top_merchants_by_share(rows.limit(0)).count() == 0


def test_learning_helpers(spark):
    assert len(learning.parameter_grid(a=[1, 2], b=[1, 2, 3])) == 6
    assert sorted(sum(learning.clusters(list("abcdefgh"), 3), [])) == list("abcdefgh")
    assert learning.groups_by_substring(["merchant:x", "user_merchant:y"], ["merchant:"])["merchant:"] == ["merchant:x", "user_merchant:y"]
    rows = spark.createDataFrame([(i, float(i % 2), float(i), bool(i % 2)) for i in range(60)], "i long, x double, y double, label boolean")
    w, out = learning.discriminant(rows, ["x", "y"], "label")
    by = {r.label: r.m for r in out.groupBy("label").agg(F.avg("ld").alias("m")).collect()}
    assert by[True] > by[False] and abs(w[0]) > abs(w[1])
    train, check = learning.hold_out(rows, 0.3, "i")
    assert train.count() + check.count() == 60 and 0 < check.count() < 40


def labelled_rows(spark, n):
    """x tells the label, y doesn't, flag is null in part."""
    rows = [(i % 7, 1, f"c{i % 3}", dt.date(2016, 5, 1 + i % 28), bool(i % 2), float(i % 2) + (i % 5) / 10, float(i % 11), None if i % 4 == 0 else bool(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, merchant_id long, coupon_id string, date date, label boolean, x double, y double, flag boolean")


def test_training_stops_is_saved_and_submits(spark, tmp_path):
    data = learning.dataset(labelled_rows(spark, 240), labelled_rows(spark, 60).drop("label"), share=0.3)
    assert data.inputs == ["x", "y", "flag"] and "label" not in data.test.columns and data.train.count() + data.validate.count() == 240
    model = learning.train_trees(data.train, data.inputs, rounds=12, depth=2, feature_share="all", validate=data.validate, tolerance=0.4)
    assert 1 <= model.stages[-1].getNumTrees < 12
    learning.save_model(model, f"{tmp_path}/model")
    learning.save_model(model, f"{tmp_path}/model")
    again = learning.load_model(f"{tmp_path}/model")
    one, two = (sorted(map(tuple, learning.submission(learning.predict(m, data.test, data.inputs)).collect())) for m in (model, again))
    assert one == two and len(one) == 60 and one[0][2].startswith("201605") and all(0 <= r[-1] <= 1 for r in one)
    assert learning.save_and_score(learning.predict(again, data.test, data.inputs), f"{tmp_path}/test") is None
    got = learning.save_and_score(learning.predict(again, data.validate, data.inputs), f"{tmp_path}/validate").first()
    assert got.auc == 1.0 and got.mean_auc == 1.0 and got.n_groups == 3
    saved = files.read_headless_csv(spark, f"{tmp_path}/test", "user_id long, coupon_id string, date string, prob double")
    assert sorted(map(tuple, saved.collect())) == one
    assert learning.importance(again, data.inputs)[0][0] == "x"


FEW = {"rounds": 1, "depth": 1, "feature_share": "all"}


def test_selection_by_scores(spark, tmp_path):
    data = selection.stored_data(learning.dataset(labelled_rows(spark, 120), labelled_rows(spark, 40), inputs=["x", "y"], share=0.3))
    plan = selection.without_each({"1": ["x", "y"]})
    without = selection.run_plan(data, plan[:1], f"{tmp_path}/without", **FEW)
    assert [r.feature for r in without.collect()] == ["x"]
    without = selection.run_plan(data, plan, f"{tmp_path}/without", pool=2, **FEW)
    by = {r.feature: r for r in without.collect()}
    assert len(by) == 2 and by["y"].validate_auc == 1.0 > by["x"].validate_auc
    files_ = sorted((tmp_path / "without").glob("part-*"))
    assert selection.run_plan(data, plan, f"{tmp_path}/without", **FEW).count() == 2
    assert [f for f in sorted((tmp_path / "without").glob("part-*")) if f not in files_ and f.stat().st_size > 2000] == []
    added = selection.run_plan(data, selection.with_each("other", ["y"], ["x", "y"]), f"{tmp_path}/with", **FEW)
    assert [(r.feature, r.test_auc) for r in added.collect()] == [("x", 1.0)]


def test_selector_from_data_to_levels(spark, tmp_path):
    data = learning.dataset(labelled_rows(spark, 120), labelled_rows(spark, 40), inputs=["x", "y", "flag"], share=0.3)
    found = selection.select_features(data, {"1": ["x", "y", "flag"]}, str(tmp_path), pool=3, **FEW)
    by = selection.save_levels(found, f"{tmp_path}/levels.json")
    assert set(by["good"] + by["bad"] + by["other"]) == {"x", "y", "flag"} and files.read_json(f"{tmp_path}/levels.json") == by
    assert {r.feature for r in selection.cluster_choice(selection.read_scores(spark, f"{tmp_path}/clusters")).collect()} == {"x"}


def test_levels_of_features(spark):
    def table(rows):
        return spark.createDataFrame([("1", f, *map(float, s)) for f, s in rows.items()], selection.COLUMNS)

    names = lambda own: spark.createDataFrame([(f,) for f in own], "feature string")
    said = lambda df: {k: sorted(r.feature for r in df.collect() if r.level == k) for k in ("good", "bad", "other")}
    flat = [5, 5, 5, 5, 5]
    without = table({"a": [1, *flat], "b": [9, 0, 5, 5, 5, 5], "c": [9, *flat], "d": [9, *flat]})
    assert {r.feature for r in selection.cluster_choice(without).collect()} == {"a", "b"}
    assert said(selection.levels(without, "low", names("abcd"))) == {"good": ["a"], "bad": ["b"], "other": ["c", "d"]}
    added = table({"e": [9, *flat], "f": [1, 5, 5, 9, 5, 5], "g": [1, *flat], "h": [1, *flat]})
    assert said(selection.feature_levels(without, added, names("abcd"), names("abcdefgh"))) == {"good": ["a", "e"], "bad": ["b", "f"], "other": ["a", "b", "c", "d", "g", "h"]}


def test_parts_and_stream(spark, tmp_path):
    assert by_sequence(spark.range(10), lambda pdf: pdf + 1, "id long", 3).agg(F.sum("id")).first()[0] == 55
    rows = spark.createDataFrame([(dt.date(2016, 1, d), "offline_receive_coupon") for d in (1, 1, 9)], "date date, event_type string")
    full = rows.selectExpr("date", "cast(null as date) date2", "event_type", "1L user_id", "1L merchant_id", "'c' coupon_id", "'90' discount_name", "1.0D distance", "cast(null as double) click_count")
    full.write.parquet(f"{tmp_path}/in")
    query = daily_counts(event_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.day, r.n) for r in spark.table("daily").collect()} == {(dt.date(2016, 1, 1), 2), (dt.date(2016, 1, 9), 1)}


@pytest.mark.parametrize("name", ["recent_conversion", "events_union", "discount_stats", "top20_active", "feat_user_coupon", "auc_global", "id_coverage", "hash_partition", "held_out", "big_merchant_split", "raw_offline", "raw_online_coupon", "raw_clicks", "raw_test", "events_csv", "discounts_csv", "profile_table", "profile_events", "merchant_places", "sample_receipts", "longest_gaps_by_function", "rolling3_median", "op_registered", "pca2", "scaled_pca", "lda1", "selector"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    said = con.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in said.description]
    clean = lambda v: None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    wanted = sorted((tuple(map(clean, r)) for r in said.fetchall()), key=repr)
    got = sorted((tuple(clean(r[c]) for c in columns) for r in queries.QUERIES[name](spark, SMALL).collect()), key=repr)
    assert got == wanted


def test_every_query_has_a_name_of_the_library():
    without = set(queries.QUERIES) - set(oracles.oracle_sql())
    assert without == {"gbt_score", "submit"}
