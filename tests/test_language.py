"""The feature language and what its operators compute, on hand-made events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daymark.operators import shaping
from daymark.plans.definitions import KEYS, features
from daymark.plans.language import WINDOWS, parse
from daymark.plans.snapshots import evaluate, plain_name

SCHEMA = "user_id long, merchant_id long, coupon_id string, event_type string, t int, distance double, discount_rate double, discount_man double, timedelta double"


def clip(x):
    return min(max(x, 0), 365)


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def receipt(t, user=1, merchant=1, coupon="a", kind="offline_receive_coupon", distance=None, rate=None, man=None, held=None):
    return (user, merchant, coupon, kind, t, distance, rate, man, held)


def test_numbers_of_features():
    shape = {e: (len((f := features(e)).measures), sum(c.operator == "/" for c in f.combinations), sum(c.operator == "-" for c in f.combinations)) for e in KEYS}
    assert shape == {"user": (85, 22, 0), "merchant": (84, 9, 0), "coupon": (35, 3, 0), "user_merchant": (12, 3, 3), "user_coupon": (3, 0, 0)}
    assert features("user").only(["recent(offline_buy_with_coupon.count/offline_receive_coupon.count)"]).names == ["recent.offline_receive_coupon.count", "recent.offline_buy_with_coupon.count", "recent(offline_buy_with_coupon.count/offline_receive_coupon.count)"]


@pytest.mark.parametrize(("text", "said"), [("recent.foo.count", r"missing ops: \['foo'\]"), ("recent(offline.count / online.count)", "no line defines"), ("offline.count", "starts with a window"), ("recent(offline.count)", "not a combination")])
def test_wrong_texts(text, said):
    with pytest.raises(ValueError, match=said):
        parse(text)


def test_comments_and_order():
    own = parse("# all\n recent(offline.count - online.count) # late\n\nrecent.offline.count\nrecent.online.count")
    assert own.names == ["recent(offline.count-online.count)", "recent.offline.count", "recent.online.count"]


def test_windows_are_clipped(spark):
    days = [0, 5, 35, 50, 80, 110, 126, 365]
    rows = events(spark, [receipt(t) for t in days])
    got = {r.date: r for r in evaluate(rows, ("user_id",), parse("\n".join(f"{w}.offline.count" for w in WINDOWS)), plain=True).collect()}
    assert sorted(got) == days
    for t in days:
        for w, (a, b) in WINDOWS.items():
            assert got[t][f"{w}_offline_count"] == sum(clip(t + a) <= d <= clip(t + b) for d in days), (t, w)


def test_three_states_and_measures(spark):
    use = "offline_buy_with_coupon"
    rows = events(spark, [receipt(100, kind=use, distance=2.0, held=3.0), receipt(101, kind=use, distance=None, held=5.0), receipt(130, user=1), receipt(100, user=2, kind=use, distance=2.0, held=1.0), receipt(101, user=2, kind=use, distance=4.0, held=2.0), receipt(130, user=2), receipt(140, user=2), receipt(130, user=3)])
    own = parse("\n".join([*(f"recent.{use}.{v}.{a}" for v in ("distance", "timedelta") for a in ("min", "max", "mean")), "future.offline_receive_coupon.deltanow.min"]))
    got = {r.user_id: r for r in evaluate(rows, ("user_id",), own, plain=True).where("date = 130").collect()}
    pick = lambda u, v: tuple(got[u][f"recent_{use}_{v}_{a}"] for a in ("min", "max", "mean"))
    assert pick(1, "distance") == (None, None, None) and pick(2, "distance") == (2, 4, 3) and pick(3, "distance") == (0, 0, 0)
    assert pick(1, "timedelta") == (3, 5, 4)
    assert [got[u]["future_offline_receive_coupon_deltanow_min"] for u in (1, 2, 3)] == [0, 10, 0]


def test_combinations_and_man200(spark):
    rows = events(spark, [receipt(100, man=199.0), receipt(100, man=200.0), receipt(101), receipt(101, kind="offline_buy_with_coupon"), receipt(130)])
    text = "recent.offline_receive_coupon.man200.count\nrecent.offline_receive_coupon.count\nrecent.offline_buy_with_coupon.count\nrecent.online.count\nrecent(offline_receive_coupon.count - offline_buy_with_coupon.count)\nrecent(offline_buy_with_coupon.count / offline_receive_coupon.count)\nrecent(offline_receive_coupon.count / online.count)"
    r = evaluate(rows, ("user_id",), parse(text), plain=True).where("date = 130").first()
    assert r.recent_offline_receive_coupon_man200_count == 1
    assert r[plain_name("recent(offline_receive_coupon.count-offline_buy_with_coupon.count)")] == 2
    assert r[plain_name("recent(offline_buy_with_coupon.count/offline_receive_coupon.count)")] == pytest.approx(1 / 3)
    assert r[plain_name("recent(offline_receive_coupon.count/online.count)")] == 0


def test_missing_coupons_are_one_value(spark):
    rows = events(spark, [*(receipt(100, user=u, coupon=c) for u, c in ((1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None))), receipt(130)])
    r = evaluate(rows, ("merchant_id",), parse("recent.offline.unique_coupon.count\nrecent.offline.unique_hotcoupon.count\nrecent.offline.unique_user.count\nrecent.offline.unique_hotuser.count"), plain=True).where("date = 130").first()
    assert (r.recent_offline_unique_coupon_count, r.recent_offline_unique_hotcoupon_count, r.recent_offline_unique_user_count, r.recent_offline_unique_hotuser_count) == (3, 1, 3, 2)


def test_distinct_counts_by_steps_equal_counts_by_hand(spark):
    rng = random.Random(3)
    rows = [receipt(rng.choice([0, 1, 10, 17, 40, 46, 76, 90, 100, 180, 181, 300, 350, 364, 365]), user=rng.randrange(6), merchant=rng.randrange(3), coupon=rng.choice(["a", "b", None]), kind=rng.choice(["offline_receive_coupon", "offline_buy_without_coupon", "online_click"])) for _ in range(300)]
    names = [f"{w}.{k}.{u}.count" for w in WINDOWS for k in ("offline", "offline_receive_coupon") for u in ("unique_user", "unique_hotuser", "unique_coupon", "unique_hotcoupon")]
    got = evaluate(events(spark, rows), ("merchant_id",), parse("\n".join(names)), plain=True).collect()
    assert len(got) == len({(r[1], r[4]) for r in rows if any(x[1] == r[1] and x[3].startswith("offline") for x in rows)})
    for r in got:
        for n in names:
            w, k, u, _ = n.split(".")
            a, b = WINDOWS[w]
            values = [str(x[0] if "user" in u else x[2]) for x in rows if x[1] == r.merchant_id and clip(r.date + a) <= x[4] <= clip(r.date + b) and (x[3] == k or k == "offline" and x[3].startswith(k))]
            least = {"unique_hotuser": 2, "unique_hotcoupon": 3}.get(u, 1)
            assert r[plain_name(n)] == sum(values.count(v) >= least for v in set(values)), (r.merchant_id, r.date, n)


def test_parts_are_as_many_as_asked_and_change_no_feature(spark):
    rng = random.Random(5)
    # a hot merchant, one with online events alone, rows without merchant
    rows = [receipt(rng.randrange(366), user=rng.randrange(9), merchant=rng.choice([1, 1, 1, 2, 3, None]), coupon=rng.choice(["a", "b", None]), kind=rng.choice(["offline_receive_coupon", "offline_buy_with_coupon", "online_click"])) for _ in range(400)]
    own = events(spark, [*rows, receipt(7, merchant=4, kind="online_click")]).cache()
    for wanted in (features("merchant"), features("merchant").only(["recent.offline_receive_coupon.count"])):
        plain, dealt = evaluate(own, ("merchant_id",), wanted, plain=True), evaluate(own, ("merchant_id",), wanted, plain=True, parts=13)
        assert dealt.rdd.getNumPartitions() == 13 and dealt.schema == plain.schema
        assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect()))
    own.unpersist()


def test_keys_without_offline_events_or_with_nulls(spark):
    rows = events(spark, [receipt(5, user=1, kind="online_click"), receipt(5, user=2), receipt(9, user=2, kind="online_click"), receipt(5, user=3, coupon=None)])
    one = parse("today.offline.count")
    assert {(r.user_id, r.date) for r in evaluate(rows, ("user_id",), one).collect()} == {(2, 5), (2, 9), (3, 5)}
    assert {r.coupon_id for r in evaluate(rows, ("coupon_id",), one).collect()} == {"a"}
    assert evaluate(rows.limit(0), ("user_id",), one).count() == 0


def test_event_fan_out_and_label(spark):
    d = dt.date
    rows = spark.createDataFrame([(1, 1, "a", "150:20", 2.0, d(2016, 3, 1), d(2016, 3, 10)), (1, 1, None, None, 1.0, None, d(2016, 3, 5)), (1, 1, "b", "0.9", None, d(2016, 3, 1), d(2016, 3, 17)), (1, 1, "c", "0.9", None, d(2016, 3, 1), d(2016, 3, 16)), (1, 1, "d", "0.9", None, d(2016, 3, 1), None)], "user_id long, merchant_id long, coupon_id string, discount string, distance double, date_received date, date date")
    got = shaping.coupon_events(shaping.labelled(rows), "offline").withColumn("label", shaping.event_label()).select("event_type", "coupon_id", "date", "date2", "label").collect()
    kind = lambda k: f"offline_{k}"
    assert set(map(tuple, got)) == {
        (kind("receive_coupon"), "a", d(2016, 3, 1), d(2016, 3, 10), True), (kind("buy_with_coupon"), "a", d(2016, 3, 10), d(2016, 3, 1), False), (kind("buy_without_coupon"), None, d(2016, 3, 5), None, False),
        (kind("receive_coupon"), "b", d(2016, 3, 1), d(2016, 3, 17), False), (kind("buy_with_coupon"), "b", d(2016, 3, 17), d(2016, 3, 1), False), (kind("receive_coupon"), "c", d(2016, 3, 1), d(2016, 3, 16), True),
        (kind("buy_with_coupon"), "c", d(2016, 3, 16), d(2016, 3, 1), False), (kind("receive_coupon"), "d", d(2016, 3, 1), None, False),
    }
    assert shaping.labelled(rows).where(F.col("label").isNull()).count() == 0


def test_label_is_of_offline_receipts_alone(spark):
    day = dt.date(2016, 3, 1)
    rows = [("offline_receive_coupon", day, day + dt.timedelta(15)), ("offline_receive_coupon", day, day + dt.timedelta(16)), ("offline_receive_coupon", day, None), ("online_receive_coupon", day, day), ("offline_buy_with_coupon", day, day)]
    got = spark.createDataFrame(rows, "event_type string, date date, date2 date").select(shaping.event_label().alias("label")).collect()
    assert [r.label for r in got] == [True, False, False, False, False]
