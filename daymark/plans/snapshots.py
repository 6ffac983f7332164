"""Features of keys as of days: each day on which a key has an event is a snapshot.

Counts, sums, least and largest values are first put together by key and day, so a key has 366 rows at most; its
windows are frames over those rows, and nothing is joined. Distinct values don't meet the snapshots either: an event of
day d counts in the windows of the snapshots of one range of days, so it is a step up and a step down, and running sums
of those steps over the days give the counts. No task's window holds more of a key than its days, or one value's days.

Where a number of parts is given, events are dealt into as many by key and day before they are put together, and days
into as many by key: what a task holds is then set by that number, not by the files' splits or by what Spark coalesces.
Where events are in buckets by a key, only days that meet the steps of distinct values are dealt, as a union has no buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import discount_struct
from ..operators.shaping import wide
from ..schema import EVENTS, OFFLINE_KINDS
from .definitions import KEYS, features
from .language import WINDOWS, Features, Measure, Steps

LAST_DAY = 365
#: What stands for a missing coupon among the distinct ones.
NO_VALUE = "nan"
#: The kind of event that is a row to learn from.
RECEIPT = "offline_receive_coupon"
#: First and last day numbers of ranges of days.
Ranges = tuple[tuple[int, int], ...]


def prepared(log: DataFrame) -> DataFrame:
    """The log with day numbers and discount fields, as snapshots need it."""
    fields = discount_struct(F.col("discount_name"))
    own = wide(log).withColumns({c: fields[c] for c in ("is_xianshi", "is_dazhe", "is_manjian", "discount_man", "discount_jian", "discount_rate")})
    return own.select(*EVENTS.names, "t", "discount_rate", "discount_man", (F.col("t") - F.col("t2")).cast("double").alias("timedelta"))


def one_of(kinds: tuple[str, ...]) -> str:
    return f"event_type IN ({', '.join(map(repr, kinds))})" if kinds else "false"


def chosen(m: Measure, steps: Steps) -> str:
    """SQL of the condition that an event belongs to a measure's selection."""
    return " AND ".join([one_of(m.kinds), *(f"coalesce({steps.by_name[f].condition}, false)" for f in m.filters)])


def in_ranges(ranges: Ranges) -> str:
    """SQL of the condition that an event's day is in one of the ranges."""
    return f"({' OR '.join(f't BETWEEN {a} AND {b}' for a, b in ranges)})"


def reached(wanted: Features, ranges: Ranges) -> Ranges:
    """The days of ranges and of the windows of all snapshots in them."""
    clip = lambda d: min(max(d, 0), LAST_DAY)
    windows = {WINDOWS[m.window] for m in wanted.measures}
    return tuple((min([a, *(clip(a + first) for first, _ in windows)]), max([b, *(clip(b + last) for _, last in windows)])) for a, b in ranges)


def exprs(named: dict[str, str]) -> list[Column]:
    """Columns of SQL expressions by name: one call for each, however large it is."""
    return [F.expr(f"{x} AS `{n}`") for n, x in named.items()]


def dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """df in a number of parts by columns; as it is without a number."""
    return df.repartition(parts, *by) if parts else df


def by_day(events: DataFrame, keys: tuple[str, ...], measures: list[Measure], steps: Steps, parts_of_days: int | None = None, receipts: Ranges | None = None) -> tuple[DataFrame, dict]:
    """Rows (keys, t) with the parts of each selection that its aggregates need; and the selections' numbers.

    n is how many events are selected, z how many of them lack the value; further parts are the aggregates' own.
    offline: how many of a day's events are of a kind that makes a key known; with ranges of receipts, how many are such.
    """
    number: dict = {}
    parts = {"offline": f"count_if({one_of(OFFLINE_KINDS)})" if receipts is None else f"count_if(event_type = '{RECEIPT}' AND {in_ranges(receipts)})"}
    for m in measures:
        g = number.setdefault((m.kinds, m.filters, m.value), len(number))
        p = chosen(m, steps)
        parts[f"n{g}"] = f"count_if({p})"
        if m.value:
            value = steps.by_name[m.value]
            if not value.relative:
                parts[f"z{g}"] = f"count_if({p} AND ({value.sql}) IS NULL)"
            for letter, (of_day, _) in steps.by_name[m.aggregate].parts.items():
                parts[f"{letter}{g}"] = of_day.format(x=f"(CASE WHEN {p} THEN {value.sql} END)")
    return dealt(events.dropna(subset=list(keys)), parts_of_days, *keys, "t").groupBy(*keys, "t").agg(*exprs(parts)), number


def framed(column: str, f: str, window: str, keys: tuple[str, ...]) -> str:
    """SQL of an aggregate f of a day's column over a window's days, clipped to the year.

    A window that lies before the year is its first day, one that lies after it its last.
    """
    first, last = WINDOWS[window]
    whole = f"PARTITION BY {', '.join(keys)}"
    end = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    out = f"{f}({column}) OVER ({whole} ORDER BY t RANGE BETWEEN {end(first)} AND {end(last)})"
    if last < 0:
        out = f"CASE WHEN t + ({last}) < 0 THEN max(CASE WHEN t = 0 THEN {column} END) OVER ({whole}) ELSE {out} END"
    if first > 0:
        out = f"CASE WHEN t + {first} > {LAST_DAY} THEN max(CASE WHEN t = {LAST_DAY} THEN {column} END) OVER ({whole}) ELSE {out} END"
    return out


def measured(days: DataFrame, number: dict, keys: tuple[str, ...], measures: list[Measure], names: dict[str, str], steps: Steps, also: list[str], receipts: Ranges | None = None) -> DataFrame:
    """(keys, t, one column a measure, and those of days that also stay) of each snapshot, that is each day of a key that
    occurs offline, or each day that counts receipts: nothing there gives 0, a missing value gives null."""
    needed = {"known": f"sum(offline) OVER (PARTITION BY {', '.join(keys)}) > 0" if receipts is None else "offline > 0"}
    over_days = {"n": "sum", "z": "sum", **{k: f for k, (_, f) in steps.parts().items()}}

    def part(letter: str, m: Measure) -> str:
        column = f"{letter}{number[m.kinds, m.filters, m.value]}"
        name = f"{column}_{m.window}"
        if name not in needed:
            needed[name] = framed(column, over_days[letter], m.window, keys)
        return name

    finals = {}
    for m in measures:
        n, aggregate, value = f"coalesce({part('n', m)}, 0)", steps.by_name[m.aggregate], m.value and steps.by_name[m.value]
        if not value or m.aggregate == "count":
            finals[names[m.name]] = n
            continue
        letters = {x: part(x, m) for x in aggregate.parts}
        whole = aggregate.whole.format(n=n, **letters)
        if value.relative:
            finals[names[m.name]] = f"CASE WHEN {n} = 0 THEN 0D ELSE {whole} - {aggregate.shift.format(n=n, **letters)} END"
        else:
            finals[names[m.name]] = f"CASE WHEN {n} = 0 THEN 0D WHEN {part('z', m)} = 0 THEN {whole} END"
    return days.select(*keys, "t", *also, *exprs(needed)).where("known").select(*keys, "t", *also, *exprs(finals))


def distinct_counts(events: DataFrame, days: DataFrame, keys: tuple[str, ...], measures: list[Measure], names: dict[str, str], steps: Steps, parts: int | None = None, parts_of_union: int | None = None) -> DataFrame:
    """days with one more column a measure: how many values occur often enough in the window.

    Of a value's events in order, each `least` neighbours are in the window of a range of snapshots; ranges begin and
    end in the same order, so what each adds to those before it is a range too: a step up and a step down.
    """
    streams: dict[tuple, list[Measure]] = {}
    for m in measures:
        of = steps.by_name[m.distinct]
        streams.setdefault((of.sql, of.least, chosen(m, steps)), []).append(m)
    most = max(least for _, least, _ in streams)
    own = ", ".join(f"CASE WHEN {p} THEN struct({i} AS stream, {least} AS least, coalesce(CAST({a} AS STRING), '{NO_VALUE}') AS value) END" for i, (a, least, p) in enumerate(streams))
    rows = events.dropna(subset=list(keys)).select(*keys, "t", F.expr(f"explode(array_compact(array({own}))) AS s"))
    rows = dealt(rows.select(*keys, "t", "s.*"), parts, *keys, "stream", "value", "t")
    counts = rows.groupBy(*keys, "stream", "least", "value", "t").agg(F.count(F.lit(1)).alias("n"))
    rows = dealt(counts, parts, *keys, "stream", "value").select(*keys, "stream", "least", "value", "t", F.expr("explode(sequence(1, CAST(least(n, least) AS INT))) AS again"))
    over = f"OVER (PARTITION BY {', '.join(keys)}, stream, value ORDER BY t, again)"
    far = " ".join(f"WHEN {k} THEN lead(t, {k - 1}) {over}" for k in range(2, most + 1))
    ranged = rows.select(*keys, "stream", "t", *exprs({"far": f"CASE least {far} ELSE t END" if far else "t", "was": f"lag(t) {over}"})).where("far IS NOT NULL")

    def begin(day: str, last: int) -> str:
        return f"CASE WHEN {day} = 0 THEN 0 ELSE greatest({day} - ({last}), 0) END"

    def end(day: str, first: int) -> str:
        return f"CASE WHEN {day} = {LAST_DAY} THEN {LAST_DAY} ELSE least({day} - ({first}), {LAST_DAY}) END"

    number, each = {m.name: i for i, m in enumerate(measures)}, []
    for i, of in enumerate(streams.values()):
        for m in of:
            first, last = WINDOWS[m.window]
            at = f"greatest({begin('far', last)}, CASE WHEN was IS NULL THEN 0 ELSE {end('was', first)} + 1 END)"
            each.append(f"CASE WHEN stream = {i} AND {at} <= {end('t', first)} THEN array(struct({number[m.name]} AS measure, {at} AS at, 1 AS step), struct({number[m.name]} AS measure, {end('t', first)} + 1 AS at, -1 AS step)) END")
    steps = ranged.select(*keys, F.expr(f"inline(flatten(array_compact(array({', '.join(each)}))))"))
    columns = [names[m.name] for m in measures]
    own = dealt(steps.select(*keys, F.col("at").alias("t"), "measure", "step"), parts, *keys, "t")
    sums = own.groupBy(*keys, "t").agg(*exprs({names[m.name]: f"sum(CASE WHEN measure = {number[m.name]} THEN step END)" for m in measures}))
    both = dealt(sums.withColumn("asked", F.lit(False)).unionByName(days.withColumn("asked", F.lit(True)), allowMissingColumns=True), parts_of_union, *keys)
    upto = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY t, asked ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return both.select(*days.columns, "asked", *exprs({c: f"coalesce(sum({c}) {upto}, 0)" for c in columns})).where("asked").drop("asked")


def evaluate(events: DataFrame, keys: tuple[str, ...], wanted: Features, plain: bool = False, parts: int | None = None, receipts: Ranges | None = None, bucketed: bool = False) -> DataFrame:
    """(keys, date, one column a feature in the order of the lines), date being the snapshot's day number.

    plain: column names with letters, digits and _ only, instead of the features' own. parts: in how many parts the work
    is done; bucketed: events are in buckets by one of the keys, which are parts already. receipts: ranges of days; only
    snapshots of days in them on which the key has a receipt are made, from the events that their windows can hold, with
    the same values.
    """
    if receipts is not None:
        events = events.where(in_ranges(reached(wanted, receipts)))
    names = {m.name: f"m{i}" for i, m in enumerate(wanted.measures)}
    counted = [m for m in wanted.measures if m.distinct]
    own = [m for m in wanted.measures if not m.distinct]
    dealing = None if bucketed else parts
    days, number = by_day(events, keys, own, wanted.steps, dealing, receipts)
    # days are narrower than snapshots, so they meet the steps of distinct values before the windows
    days = distinct_counts(events, days, keys, counted, names, wanted.steps, dealing, parts) if counted else dealt(days, dealing, *keys)
    out = measured(days, number, keys, own, names, wanted.steps, [names[m.name] for m in counted], receipts)
    sql = {m.name: names[m.name] for m in wanted.measures}
    for c in wanted.combinations:
        x, y = names[c.left], names[c.right]
        sql[c.name] = f"CASE WHEN {y} = 0 THEN 0D ELSE {x} / {y} END" if c.operator == "/" else f"{x} - {y}"
    label = plain_name if plain else str
    return out.select(*keys, F.col("t").alias("date"), *exprs({label(n): sql[n] for n in wanted.names}))


def plain_name(name: str) -> str:
    return "".join(c if c.isalnum() else {"-": "_minus_", "/": "_per_"}.get(c, "_") for c in name).strip("_")


def entity_features(events: DataFrame, entity: str, plain: bool = False, only=None, parts: int | None = None) -> DataFrame:
    wanted = features(entity)
    return evaluate(events, KEYS[entity], wanted.only(only) if only is not None else wanted, plain, parts)
