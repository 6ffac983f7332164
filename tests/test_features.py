"""Raw files, own steps of the language, places, functions over keys, profiles, samples and moments on hand-made rows."""

import collections
import datetime as dt
import hashlib
import random
import resource
import shutil
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daymark.functions.scalars import with_discount_fields
from daymark.operators import learning, ranking, reports, shaping
from daymark.operators.partitions import by_key, streamed
from daymark.plans import classic, merging, queries
from daymark.plans.definitions import KEYS
from daymark.plans.language import STEPS, WINDOWS, Aggregate, Distinct, Filter, Value, parse
from daymark.plans.queries import INPUTS, Log, rounded
from daymark.plans.snapshots import entity_features, evaluate, plain_name
from daymark.sources import files

SMALL = "/root/testdata/sf0.001"
LINE = "user_id long, merchant_id long, coupon_id string, discount string, distance double, date_received date, date date, click boolean"


def lines(spark):
    d = dt.date
    rows = [
        (1, 2, "7", "150:20", None, d(2016, 3, 1), None, False), (1, 2, None, None, 0.0, None, d(2016, 3, 5), False), (3, 2, "a,\"b", "fixed", 3.0, d(2016, 3, 1), d(2016, 3, 4), False),
        (4, 2, None, None, None, None, d(2016, 3, 5), True), (4, 2, None, None, None, None, d(2016, 3, 5), True), (5, 2, "", "0.9", None, d(2016, 3, 1), None, False),
    ]
    return spark.createDataFrame(rows, LINE)


def test_raw_offline_there_and_back(spark, tmp_path):
    own = lines(spark)
    files.write_typed_csv(shaping.raw_offline(own), f"{tmp_path}/off")
    got = shaping.typed_offline(files.read_offline(spark, f"{tmp_path}/off"))
    wanted = shaping.labelled(own.drop("click"))
    assert got.columns == wanted.columns and sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    assert "null" in (tmp_path / "off").glob("part-*.csv").__next__().read_text() and (tmp_path / "off").glob("part-*.csv").__next__().read_text().startswith("User_id,Merchant_id,Coupon_id")


def test_raw_online_is_split_by_action(spark, tmp_path):
    own = lines(spark).drop("distance")
    files.write_typed_csv(shaping.raw_online(own), f"{tmp_path}/on")
    raw = files.read_online(spark, f"{tmp_path}/on")
    assert collections.Counter(r.Action for r in raw.collect()) == {"0": 2, "1": 2, "2": 2}
    clicks, others = shaping.split_clicks(raw)
    assert [tuple(r) for r in shaping.typed_clicks(clicks).collect()] == [(4, 2, dt.date(2016, 3, 5), 2)]
    wanted = with_discount_fields(own.where("not click").drop("click"), "discount")
    assert sorted(map(repr, shaping.typed_online_coupon(others).collect())) == sorted(map(repr, wanted.collect()))


def test_raw_test_has_receipts_without_use(spark, tmp_path):
    files.write_typed_csv(shaping.raw_test(lines(spark)), f"{tmp_path}/test")
    got = shaping.typed_test(files.read_test(spark, f"{tmp_path}/test"))
    assert "date" not in got.columns and "label" not in got.columns and {r.coupon_id for r in got.collect()} == {"7", "a,\"b", ""}


@pytest.mark.parametrize(("head", "row"), [
    ("User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received", "x,2,7,0.9,1.0,20160301"), ("User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received", "1,2,7,0.9,far,20160301"),
    ("User_id,Merchant_id,Coupon_id,Distance,Discount_rate,Date_received", "1,2,7,1.0,0.9,20160301"),
])
def test_bad_rows_and_heads_fail(spark, tmp_path, head, row):
    (tmp_path / "test.csv").write_text(f"{head}\n{row}\n")
    with pytest.raises(Exception, match="(?i)malformed|header|FAILED_READ_FILE"):
        files.read_test(spark, f"{tmp_path}/test.csv").collect()


def test_a_text_null_fails_the_write(spark, tmp_path):
    with pytest.raises(Exception, match="stands for a missing value"):
        files.write_typed_csv(spark.createDataFrame([("null",)], "Coupon_id string"), f"{tmp_path}/x")


def test_events_and_discounts_as_csv(spark, tmp_path):
    own = shaping.event_log(shaping.labelled(lines(spark).where("not click").drop("click")), with_discount_fields(lines(spark).drop("click", "distance"), "discount"), shaping.click_counts(lines(spark).where("click")))
    discounts = shaping.discount_table(own)
    files.write_typed_csv(own, f"{tmp_path}/events")
    files.write_typed_csv(discounts, f"{tmp_path}/discounts")
    assert sorted(map(repr, files.read_events(spark, f"{tmp_path}/events").collect())) == sorted(map(repr, own.collect()))
    assert sorted(map(repr, files.read_discounts(spark, f"{tmp_path}/discounts").collect())) == sorted(map(repr, discounts.collect()))


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    for t in ("orders", "lineitem", "part"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path)
    log = Log(spark, str(tmp_path))
    n, raw = log.events.count(), files.read_offline(spark, log.raw("offline")).count()
    first = log.lines.inputFiles()
    assert log.lines.inputFiles() == first
    whole = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    whole.where("l_orderkey % 3 = 0").write.parquet(f"{tmp_path}/few")
    (tmp_path / "lineitem.parquet").unlink()
    (tmp_path / "few").rename(tmp_path / "lineitem.parquet")
    assert 0 < log.events.count() < n and 0 < files.read_offline(spark, log.raw("offline")).count() < raw
    files.removed(spark, first[0].rpartition("/")[0])
    again = log.lines.inputFiles()
    files.removed(spark, again[0].rpartition("/")[0])
    assert log.lines.count() > 0 and log.lines.inputFiles() != again


EVENT = "user_id long, merchant_id long, coupon_id string, event_type string, t int, distance double, discount_rate double, discount_man double, timedelta double"
OWN = STEPS.plus(
    Filter("near", "distance < 3"), Value("gain", "discount_man * 2"), Distinct("unique_far", "CAST(distance AS INT)", 2), Aggregate("total", "{s}", {"s": ("sum({x})", "sum")}, "{n} * t"),
    Aggregate("spread", "CASE WHEN {n} > 1 THEN sqrt(greatest(({q} - {s} * {s} / {n}) / ({n} - 1), 0D)) END", {"s": ("sum({x})", "sum"), "q": ("sum({x} * {x})", "sum")}, "0D"),
)


def test_own_steps_against_counts_by_hand(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), 1, "c", rng.choice(["offline_receive_coupon", "offline_buy_with_coupon", "online_click"]), rng.choice([0, 3, 90, 100, 140, 150, 200, 365]), rng.choice([None, 1.0, 2.0, 5.0]), None, rng.choice([1.0, 4.0, None]) if i % 9 == 0 else float(rng.randrange(6)), None) for i in range(200)]
    names = [f"{w}.offline.{x}" for w in WINDOWS for x in ("near.count", "near.gain.total", "gain.spread", "unique_far.count", "near.unique_far.count", "deltanow.total", "deltanow.spread", "gain.mean")]
    got = evaluate(spark.createDataFrame(rows, EVENT), ("user_id",), parse("\n".join(names), OWN), plain=True).collect()
    clip = lambda x: min(max(x, 0), 365)
    for r in got:
        for n in names:
            w, _, *steps, last = n.split(".")
            a, b = WINDOWS[w]
            own = [x for x in rows if x[0] == r.user_id and x[3].startswith("offline") and clip(r.date + a) <= x[4] <= clip(r.date + b) and ("near" not in steps or x[5] is not None and x[5] < 3)]
            if "unique_far" in steps:
                wanted = sum(c >= 2 for c in collections.Counter(None if x[5] is None else int(x[5]) for x in own).values())
            elif last == "count":
                wanted = len(own)
            else:
                values = [x[4] - r.date if "deltanow" in steps else None if x[7] is None else x[7] * 2 for x in own]
                f = {"total": sum, "mean": statistics.mean, "spread": lambda v: statistics.stdev(v) if len(v) > 1 else None}[last]
                wanted = 0 if not values else None if None in values else f(values)
            said = r[plain_name(n)]
            assert (said is None and wanted is None) or said == pytest.approx(wanted, abs=1e-5), (r.user_id, r.date, n)


@pytest.mark.parametrize("step", [Filter("offline", "true"), Filter("recent", "true"), Value("no name", "t"), Aggregate("other", "{s}", {"s": ("max({x})", "max")}), Aggregate("other", "{n}", {"n": ("sum({x})", "sum")})])
def test_steps_that_cannot_be_registered(step):
    with pytest.raises(ValueError, match="not a new step|mean something else"):
        STEPS.plus(step)


def test_texts_need_their_steps():
    with pytest.raises(ValueError, match="missing ops"):
        parse("recent.offline.near.count")
    with pytest.raises(ValueError, match="nothing to measure"):
        parse("recent.offline.mean")
    own = parse("recent.offline.near.count\ntoday(offline.near.count / offline.count)\ntoday.offline.near.count\ntoday.offline.count", OWN)
    assert own.names == ["recent.offline.near.count", "today(offline.near.count/offline.count)", "today.offline.near.count", "today.offline.count"]
    assert own.only(["today(offline.near.count/offline.count)"]).names == own.names[1:]


@pytest.mark.parametrize("parts", [1, 7])
def test_places_and_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(i, None if i % 5 == 0 else rng.choice([3, 3, 3, 1]), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, day int, n long").repartition(parts)
    got = ranking.placed(df, [F.col("day").desc_nulls_last(), F.col("id")], ("n",)).collect()
    upto = 0
    for place, (row, r) in enumerate(zip(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])), sorted(got, key=lambda r: r.place), strict=True), 1):
        upto += row[2]
        assert (r.id, r.day, r.n, r.place, r.upto_n) == (*row, place, upto)
    assert ranking.placed(df.limit(0), [F.col("id")], ("n",)).count() == 0


def test_functions_see_a_key_in_batches(spark):
    """Half of all rows have one key; the function gets its rows in order, a batch at a time, in bounded memory."""
    n, most = 1_500_000, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(None).cast("long")).otherwise(F.col("id") % 50).alias("k"), F.hash("id").alias("x"))

    def watch(key, batches):
        count, rows, largest, last, ordered = 0, 0, 0, None, True
        for b in batches:
            x = b.column("x").to_numpy()
            ordered = ordered and bool((np.diff(x) >= 0).all()) and (last is None or x[0] >= last)
            count, rows, largest, last = count + 1, rows + len(x), max(largest, len(x)), x[-1]
        out = [key[0]], [count], [rows], [largest], [ordered], [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["k", "times", "rows", "largest", "ordered", "mb"])

    got = {r.k: r for r in by_key(df, "k", watch, "k long, times long, rows long, largest long, ordered boolean, mb long", ("x",)).collect()}
    assert len(got) == 26 and got[None].rows == n // 2 and got[None].times > 10 and all(r.ordered and r.largest <= most and r.mb < 1024 for r in got.values())
    assert {r.rows for k, r in got.items() if k is not None} == {n // 50}


def test_functions_over_keys_may_stop_early(spark):
    rows = [(i % 3, str(i % 2) if i % 4 else None, i) for i in range(90)]
    first = lambda key, batches: (b.slice(0, 1) for b in [next(batches)])
    got = by_key(spark.createDataFrame(rows, "a long, b string, c long"), ("a", "b"), first, "a long, b string, c long", ("c",))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((a, b, min(z for x, y, z in rows if (x, y) == (a, b))) for a, b in {(x, y) for x, y, _ in rows}), key=repr)
    assert sorted(r.c for r in streamed(got)) == sorted(r.c for r in got.collect())


def test_profile_of_all_types(spark):
    rows = [(1, 2.5, "b", True, dt.date(2016, 3, 1), dt.datetime(2016, 3, 1, 5), [1], None), (None, 10.0, "é", None, None, None, None, None), (9, 2.5, "", False, dt.date(2015, 3, 1), dt.datetime(2016, 3, 1, 4), [1, 2], None), (9, None, "b", True, None, None, [1], None)]
    df = spark.createDataFrame(rows, "a int, `b.c` double, c string, d boolean, e date, f timestamp, g array<int>, h decimal(5,2)")
    got = {r.column_name: tuple(r)[1:] for r in reports.profile(df).collect()}
    assert got["a"] == ("int", 4, 16, 2, 1, "1", "9", "1", "9") and got["b.c"] == ("double", 4, 32, 2, 1, "2.5", "10.0", "10.0", "2.5")
    assert got["c"] == ("string", 4, 4, 3, 0, "", "é", "", "b") and got["d"] == ("boolean", 4, 4, 2, 1, "false", "true", "false", "true")
    assert got["e"][5:] == ("2015-03-01", "2016-03-01", "2015-03-01", "2015-03-01") and got["f"][5:7] == ("2016-03-01 04:00:00", "2016-03-01 05:00:00")
    assert got["h"] == ("decimal(5,2)", 4, 0, 0, 4, None, None, None, None) and got["g"][:1] + got["g"][2:5] == ("array<int>", 11, 2, 1)
    none = reports.profile(df.limit(0)).collect()
    assert len(none) == 8 and all((r.n_rows, r.n_bytes, r.n_distinct, r.n_null, r.min_value) == (0, 0, 0, 0, None) for r in none)


def test_profile_shuffles_values_once(spark, capsys):
    reports.profile(spark.read.parquet(f"{SMALL}/events.parquet")).explain()
    plan = capsys.readouterr().out
    assert plan.count("Expand") == 0 and plan.count("Exchange hashpartitioning") == 2


def test_samples_are_the_same_in_any_layout(spark):
    rows = [(i % 4 or None, i) for i in range(200)]
    hashed = lambda k, x: hashlib.md5(f"5|{'' if k is None else k}|{x}".encode()).hexdigest()
    wanted = sorted(((k, x) for g in {k for k, _ in rows} for k, x in sorted((r for r in rows if r[0] == g), key=lambda r: hashed(*r))[:6]), key=repr)
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "k long, x long").repartition(parts)
        assert sorted(map(tuple, reports.sample_by_key(df, "k", 6, seed=5).collect()), key=repr) == wanted


def test_coverage_names_the_missing(spark):
    a, b = (spark.createDataFrame([(x,) for x in own], "id long") for own in ([1, 2, None], [2, 3, 3, 4, 5, 6, 7, None]))
    r = reports.key_coverage(a, b, "id").first()
    missing = sorted([3, 4, 5, 6, 7], key=lambda x: hashlib.md5(f"0|{x}".encode()).hexdigest())[:4]
    assert tuple(r) == ("id", 2, 6, 5, 5 / 6, ",".join(map(str, missing)))
    r = reports.key_coverage(a, b.limit(0), "id").first()
    assert (r.n_total, r.n_missing, r.miss_ratio, r.missing) == (0, 0, None, "")


def test_rolling_functions(spark):
    rows = [(1, i, v) for i, v in enumerate([5.0, 1.0, None, 2.0, 8.0, 4.0, 6.0])] + [(2, 0, 1.0), (2, 1, 2.0)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    got = reports.rolling_apply(df, "t", "v", lambda a: F.array_max(a) - F.array_min(a), 3, "k")
    assert sorted((r.k, r.t, r.rolling) for r in got.collect()) == [(1, 5, 6.0), (1, 6, 4.0)]


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, "a", 3.0)], "id long, kind string, x double")
    assert {tuple(r) for r in reports.lookup(df, "id", 1).collect()} == {(1, "id", "1"), (1, "kind", "a"), (1, "x", None), (2, "id", "1"), (2, "kind", "b"), (2, "x", "2.0")}
    assert {tuple(r) for r in reports.key_counts(df, "id", 1, "kind").collect()} == {("a", 1), ("b", 1)} and reports.lookup(df, "id", 9).count() == 0


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * [1, 5, 1e-3, 100, 2, 0] + [0, 3, 1, 1e6, 0, 7]
    label = rng.integers(0, 2, 400).astype(bool)
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), bool(y)) for r, y in zip(x, label, strict=True)], ", ".join(f"{n} double" for n in names) + ", label boolean").repartition(5)
    for key, own in (("true", x[label]), ("false", x[~label])):
        got = learning.moments(df, names, "label")[key]
        assert got.n == len(own) and np.allclose(got.mean, own.mean(axis=0)) and np.allclose(got.scatter, (own - own.mean(axis=0)).T @ (own - own.mean(axis=0)), rtol=1e-6, atol=1e-6)
    for scale in (False, True):
        out = np.array([r[-6:] for r in learning.components(df, names, 6, scale=scale).collect()])
        centred = (x - x.mean(axis=0)) / (np.where(x.std(axis=0, ddof=1) > 1e-9, x.std(axis=0, ddof=1), 1) if scale else 1)
        values = np.sort(np.linalg.eigvalsh(np.cov(centred.T)))[::-1]
        assert np.allclose(np.cov(out.T), np.diag(values), atol=1e-6 * values[0]) and np.allclose(out.mean(axis=0), 0, atol=1e-5)
    white = np.array([r[-2:] for r in learning.components(df, names, 2, whiten=True).collect()])
    assert np.allclose(np.cov(white.T), np.eye(2), atol=1e-6)
    with pytest.raises(ValueError, match="both classes"):
        learning.discriminant(df.where("label"), names, "label")
    assert learning.components(df.limit(0), names).count() == 0


def test_features_of_users_read_buckets(spark):
    """The log in buckets by user: what is read isn't shuffled, only the rows by user and day are, once."""
    plan = entity_features(Log(spark, SMALL).by_user, "user", plain=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == plan.count("FileScan") and plan.count("Exchange") <= 1
    assert Log(spark, SMALL).by_user.count() == Log(spark, SMALL).prepared.count()


def test_bundles_of_users_scan_each_source_three_times_at_most(spark):
    log = Log(spark, SMALL)
    plan = classic.user_features(log.offline, log.clicks, log.online_coupon)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "online" in x]
    assert len(scans) <= 8 and "hashpartitioning(last" not in plan


def test_tables_and_names_there_and_back(spark, tmp_path):
    files.write_table(spark.range(5), str(tmp_path), "few")
    files.write_table(spark.range(3), str(tmp_path), "few")
    assert files.read_table(spark, str(tmp_path), "few").count() == 3
    files.write_json(["x", "y"], f"{tmp_path}/inputs.json")
    rows = spark.createDataFrame([(i, "c", dt.date(2016, 5, 1 + i % 28), i % 2 == 0, float(i), 1.0, 2.0) for i in range(40)], "user_id long, coupon_id string, date date, label boolean, x double, y double, z double")
    data = learning.dataset(rows, rows, files.read_json(f"{tmp_path}/inputs.json"))
    assert data.inputs == ["x", "y"] and "z" not in data.train.columns and {"user_id", "label"} <= set(data.test.columns)


def test_merged_rows_without_ids(spark):
    one = lambda key, kind, v: spark.createDataFrame([(v, 2.0, True)], f"{key} {kind}, {key}_n double, {key}_is_flag boolean")
    rows = spark.createDataFrame([(1, 1, "a", "90", dt.date(2016, 5, 1), 3.0, True), (2, 9, "b", "80", dt.date(2016, 5, 1), None, False)], "user_id long, merchant_id long, coupon_id string, discount_name string, date_received date, distance double, label boolean")
    tables = (one("user_id", "long", 1), one("merchant_id", "long", 1), one("coupon_id", "string", "a"), one("discount_name", "string", "90"), one("distance", "double", 12.0))
    got = classic.merged_classic(rows, *tables)
    assert not {"user_id", "merchant_id", "coupon_id", "discount_name", "date_received"} & set(got.columns)
    assert {(r.distance, r.user_id_n, r.user_id_is_flag, r.distance_n, r.label) for r in got.collect()} == {(3.0, 2.0, True, 0.0, True), (12.0, 0.0, False, 0.0, False)}
    assert "user_id" in classic.merged_classic(rows, *tables, keep_ids=True).columns


@pytest.mark.parametrize("hot", [False, True])
def test_a_key_with_half_of_all_rows_gets_no_bucket(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(files, "MOST_BUCKETS", 1)
    rows = spark.range(3000).select(F.when((F.col("id") % 2 == 0) & F.lit(hot), F.lit(-1)).otherwise(F.col("id") % 500).alias("k"), "id")
    for _ in range(2):
        own = files.stored_by(spark, str(tmp_path), f"rows_{hot}", lambda: rows, (), "k", "id")
        plan = own.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert ("Bucketed: true" in plan) != hot and own.count() == 3000 and ("Exchange" in plan) == hot


@pytest.mark.parametrize("entity", ["merchant", "coupon"])
def test_parts_of_features_grow_with_the_files(spark, monkeypatch, entity):
    size = sum(n for _, n, _ in files.state_of(spark, SMALL, INPUTS))
    few = Log(spark, SMALL).entity(entity)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(files, "PART_BYTES", -(-size // 11))
    many = Log(spark, SMALL).entity(entity)
    assert many.rdd.getNumPartitions() == 11
    assert rounded(many).exceptAll(rounded(few)).count() == 0


def test_days_of_buckets_that_meet_steps_are_dealt_into_parts_of_the_files(spark, monkeypatch):
    """The union of days and steps of distinct values has no buckets; its parts are as many as the inputs' size asks for."""
    size = sum(n for _, n, _ in files.state_of(spark, SMALL, INPUTS))
    few = Log(spark, SMALL).entity("user")
    assert files.in_buckets(spark, SMALL, "events", "user_id")
    monkeypatch.setattr(files, "PART_BYTES", -(-size // 11))
    many = Log(spark, SMALL).entity("user")
    assert many.rdd.getNumPartitions() == 11 and rounded(many).exceptAll(rounded(few)).count() == 0


def test_the_log_is_joined_in_parts_of_the_files(spark, monkeypatch):
    """No join of the log's derivation keeps to Spark's number of parts where the inputs' size asks for more."""
    monkeypatch.setattr(queries, "stored", lambda spark, folder, name, build, inputs=(): build())
    monkeypatch.setattr(files, "PART_BYTES", -(-sum(n for _, n, _ in files.state_of(spark, SMALL, INPUTS)) // 11))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = Log(spark, SMALL).lines._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert len(dealt) == 4 and all(", 11)" in x for x in dealt)
        own = Log(spark, SMALL).prepared
        dealt = [x for x in own._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(user_id" in x and "merchant_id" not in x]
        assert dealt and all(", 11)" in x for x in dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    monkeypatch.undo()
    assert rounded(own).exceptAll(rounded(Log(spark, SMALL).prepared)).count() == 0


def test_merges_deal_out_narrow_tables_first_and_keep_the_order_of_columns(spark):
    d, names = dt.date(1996, 5, 1), {"user": 5, "merchant": 4, "coupon": 3, "user_merchant": 2, "user_coupon": 1}
    rows = spark.createDataFrame([(1, 2, "a", d, 3.0, "150:20", True), (7, None, "b", d, None, None, False)], "user_id long, merchant_id long, coupon_id string, date date, distance double, discount_name string, label boolean")
    ids = {"user_id": (1, "long"), "merchant_id": (2, "long"), "coupon_id": ("a", "string")}
    tables = {e: spark.createDataFrame([(*(ids[k][0] for k in KEYS[e]), 121, *range(n))], f"{', '.join(f'{k} {ids[k][1]}' for k in KEYS[e])}, date int, {', '.join(f'{e[:3]}{len(e)}{i} int' for i in range(n))}") for e, n in names.items()}
    got = merging.merged(rows, shaping.discount_table(rows), tables, separator="_", parts=3)
    own = [f"{e}_{e[:3]}{len(e)}{i}" if e != "user_coupon" else f"{e[:3]}{len(e)}{i}" for e, n in names.items() for i in range(n)]
    assert got.columns[:4] == ["user_id", "coupon_id", "date", "merchant_id"] and got.columns[-17:] == ["date_dayofweek", "date_dayofmonth", *own]
    first, other = got.orderBy("user_id").collect()
    assert (first.date, first.date_dayofweek, first.date_dayofmonth, first.discount_man) == (121, 2, 1, 150) and list(first[-15:]) == [i for n in names.values() for i in range(n)] and list(other[-15:]) == [None] * 15
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert ["merchant_id" in x and "user_id" not in x for x in joins[:2]] == [False, True] and "coupon_id" in joins[4] and "user_id" in joins[4]


@pytest.mark.parametrize("entity", ["user", "merchant", "coupon", "user_merchant", "user_coupon"])
def test_features_of_receipts_are_those_of_all_days(spark, entity):
    """Only days with a receipt in one of the ranges, with the values that all events give; early days see day 0."""
    past, ranges, keys = queries.Past(spark, SMALL), ((20, 40), (121, 243), (258, 304)), [*KEYS[entity], "date"]
    days = past.prepared.where("event_type = 'offline_receive_coupon' AND (t BETWEEN 20 AND 40 OR t BETWEEN 121 AND 243 OR t BETWEEN 258 AND 304)").withColumn("date", F.col("t")).select(keys).dropna().distinct()
    whole = rounded(past.entity(entity)).join(days, keys, "left_semi")
    own = rounded(past.entity(entity, receipts=ranges))
    assert own.count() == days.count() and own.select(whole.columns).exceptAll(whole).count() == 0 and whole.count() == days.count()


def test_both_ranges_of_a_data_set_are_one_table(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "stored", lambda spark, folder, name, *more: made.append(name) or files.stored(spark, folder, name, *more))
    data = queries.dataset_of(spark, SMALL)
    assert [n for n in made if n.startswith("rows")] == ["rows"]
    months = {n: {r.m for r in getattr(data, n).select(F.month("date").alias("m")).distinct().collect()} for n in ("train", "test")}
    assert months["train"] <= {5, 6, 7, 8} and months["test"] <= {9, 10} and all(months.values())
