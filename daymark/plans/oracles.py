"""SQL that computes the queries another way, for checking them."""

from __future__ import annotations

from ..functions.scalars import DATE_FLAGS, HOLIDAYS, WORKDAYS
from ..schema import OFFLINE_KINDS
from .definitions import KEYS, features
from .language import WINDOWS, Features, parse
from .queries import FEATURES, LABELS, OPERATORS, SPLIT
from .snapshots import plain_name

LINES = """lines AS (
 SELECT o_custkey AS user_id, l_suppkey AS merchant_id, CASE WHEN l_returnflag <> 'N' THEN CAST(l_partkey AS VARCHAR) END AS coupon_id,
  CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_linenumber % 2 = 1 THEN concat(CAST(trunc(l_quantity) AS INT) * 10, ':', l_suppkey % 9 + 1)
   ELSE CAST(CAST(100 - round(l_discount * 100) AS INT) AS VARCHAR) END END AS discount,
  CASE WHEN l_linestatus <> 'O' AND p_size % 12 <> 11 THEN CAST(p_size % 12 AS DOUBLE) END AS distance,
  CASE WHEN l_returnflag <> 'N' THEN CAST(o_orderdate AS DATE) END AS date_received,
  CASE l_returnflag WHEN 'R' THEN CAST(o_orderdate AS DATE) + CAST(CAST(trunc(l_quantity) AS INT) % 31 AS INT) WHEN 'N' THEN CAST(o_orderdate AS DATE) END AS date,
  l_linestatus = 'O' AS online, l_linestatus = 'O' AND l_returnflag = 'N' AND l_linenumber >= 5 AS click, l_linenumber AS line, l_orderkey AS order_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
 WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31')"""
KEPT = "kept AS (SELECT * FROM lines WHERE date IS NULL OR date <= DATE '1996-12-31')"


def discount_sql(source: str, name: str) -> str:
    """A table with the fields of its discount column."""
    return f"""{name} AS (SELECT * EXCLUDE (cut, man_, jian_, rate_),
  CASE WHEN discount = 'fixed' THEN 'fixed' WHEN man_ IS NOT NULL THEN concat(CAST(man_ AS BIGINT), ':', CAST(jian_ AS BIGINT)) WHEN rate_ IS NOT NULL THEN CAST(CAST(trunc(rate_ * 100::DOUBLE) AS BIGINT) AS VARCHAR) END AS discount_name,
  coalesce(discount = 'fixed', false) AS is_xianshi, rate_ IS NOT NULL AS is_dazhe, man_ IS NOT NULL AS is_manjian,
  CASE WHEN man_ IS NOT NULL THEN man_ WHEN rate_ IS NOT NULL THEN 0.0::DOUBLE END AS discount_man, jian_ AS discount_jian,
  CASE WHEN man_ IS NOT NULL THEN 1 - jian_ / man_ ELSE rate_ END AS discount_rate
 FROM (SELECT *, strpos(discount, ':') AS cut,
   CASE WHEN strpos(discount, ':') > 0 THEN CAST(split_part(discount, ':', 1) AS DOUBLE) END AS man_,
   CASE WHEN strpos(discount, ':') > 0 THEN CAST(split_part(discount, ':', 2) AS DOUBLE) END AS jian_,
   CASE WHEN strpos(discount, ':') = 0 AND discount <> 'fixed' THEN CASE WHEN CAST(discount AS DOUBLE) > 1 THEN CAST(discount AS DOUBLE) / 100 ELSE CAST(discount AS DOUBLE) END END AS rate_ FROM {source}))"""


TYPED = discount_sql("kept", "typed")
OFFLINE = """offline AS (SELECT user_id, merchant_id, coupon_id, distance, date_received, date, discount_name, is_dazhe, is_manjian, discount_man, discount_jian, discount_rate,
  coalesce(coupon_id IS NOT NULL AND date_received IS NOT NULL AND date - date_received <= 15, false) AS label FROM typed WHERE NOT online)"""
ONLINE = """online_coupon AS (SELECT user_id, merchant_id, coupon_id, date_received, date, discount_name, is_xianshi, is_dazhe, is_manjian, discount_man, discount_jian, discount_rate FROM typed WHERE online AND NOT click)"""
CLICKS = "clicks AS (SELECT user_id, merchant_id, date, count(*) AS count FROM kept WHERE click GROUP BY ALL)"


def events_of(source: str, line: str, where: str = "true") -> str:
    distance = "distance" if line == "offline" else "CAST(NULL AS DOUBLE)"
    common = f"user_id, merchant_id, coupon_id, discount_name, {distance} AS distance, CAST(NULL AS DOUBLE) AS click_count FROM {source} WHERE {where}"
    return f"""SELECT date, CAST(NULL AS DATE) AS date2, '{line}_buy_without_coupon' AS event_type, {common} AND (coupon_id IS NULL OR date_received IS NULL)
 UNION ALL SELECT date_received, date, '{line}_receive_coupon', {common} AND coupon_id IS NOT NULL AND date_received IS NOT NULL
 UNION ALL SELECT date, date_received, '{line}_buy_with_coupon', {common} AND coupon_id IS NOT NULL AND date_received IS NOT NULL AND date IS NOT NULL"""


KNOWN = "user_id IN (SELECT user_id FROM offline)"
EVENTS = f"""log AS ({events_of("offline", "offline")} UNION ALL {events_of("online_coupon", "online", KNOWN)}
 UNION ALL SELECT date, NULL, 'online_click', user_id, merchant_id, NULL, NULL, NULL, CAST(count AS DOUBLE) FROM clicks WHERE {KNOWN})"""
DIM = discount_sql("(SELECT DISTINCT discount_name AS discount FROM log WHERE discount_name IS NOT NULL)", "dim_")
DISCOUNTS = "discounts AS (SELECT discount AS discount_name, is_xianshi, is_dazhe, is_manjian, discount_man, discount_jian, discount_rate FROM dim_)"
EV = """ev AS (SELECT l.*, d.discount_rate, d.discount_man, dayofyear(date) - 1 AS t, CAST(dayofyear(date) - dayofyear(date2) AS DOUBLE) AS timedelta FROM log l LEFT JOIN discounts d USING (discount_name))"""
BASE = ", ".join((LINES, KEPT, TYPED, OFFLINE, ONLINE, CLICKS, EVENTS, DIM.replace("SELECT * EXCLUDE (cut, man_, jian_, rate_),", "SELECT discount,"), DISCOUNTS, EV))


def sql(select: str, more: str = "") -> str:
    return f"WITH {BASE}{', ' + more if more else ''} {select}"


def window_sql(name: str) -> str:
    a, b = WINDOWS[name]
    clip = lambda n: f"least(greatest(s.t + ({n}), 0), 365)"
    return f"e.t BETWEEN {clip(a)} AND {clip(b)}"


def six_digits(x: str) -> str:
    """Six digits, with halves told by the first ten."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), 6) AS DOUBLE)"


def features_sql(keys: tuple[str, ...], wanted: Features, base: str | None = None) -> str:
    """Every feature straight from the events of a key, snapshot by snapshot. base: None, or a table like ev."""
    columns = {}
    for m in wanted.measures:
        p = f"{window_sql(m.window)} AND e.event_type IN ({', '.join(map(repr, m.kinds))})" + " AND coalesce(e.discount_man >= 200, false)" * ("man200" in m.filters)
        if m.distinct:
            attribute, least = {"unique_user": ("user_id", 1), "unique_merchant": ("merchant_id", 1), "unique_coupon": ("coupon_id", 1), "unique_hotuser": ("user_id", 2), "unique_hotcoupon": ("coupon_id", 3)}[m.distinct]
            x = f"coalesce(CAST(e.{attribute} AS VARCHAR), 'nan')"
            columns[m.name] = f"coalesce(len(list_filter(map_values(histogram({x}) FILTER (WHERE {p})), lambda c: c >= {least})), 0)"
        elif m.aggregate == "count":
            columns[m.name] = f"count(*) FILTER (WHERE {p})"
        else:
            x = "CAST(e.t - s.t AS DOUBLE)" if m.value == "deltanow" else f"CAST(e.{m.value} AS DOUBLE)"
            f = {"min": "min", "max": "max", "mean": "avg"}[m.aggregate]
            columns[m.name] = f"CASE WHEN count(*) FILTER (WHERE {p}) = 0 THEN 0.0::DOUBLE WHEN count(*) FILTER (WHERE {p} AND {x} IS NULL) > 0 THEN NULL ELSE {f}({x}) FILTER (WHERE {p}) END"
    on = " AND ".join(f"e.{k} = s.{k}" for k in keys)
    names = {m.name: f"m{i}" for i, m in enumerate(wanted.measures)}
    shown = lambda m: names[m.name] if m.distinct or m.aggregate == "count" else six_digits(names[m.name])
    combos = [(six_digits(f"CASE WHEN {names[c.right]} = 0 THEN 0.0::DOUBLE ELSE {names[c.left]}::DOUBLE / {names[c.right]} END") if c.operator == "/" else f"{names[c.left]} - {names[c.right]}") + f' AS "{plain_name(c.name)}"' for c in wanted.combinations]
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    listed = ", ".join(keys)
    spine = f"known AS (SELECT DISTINCT {listed} FROM ev WHERE event_type IN ({', '.join(map(repr, OFFLINE_KINDS))}) AND {known}), spine AS (SELECT DISTINCT {listed}, t FROM ev SEMI JOIN known USING ({listed}))"
    inner = f"SELECT {', '.join(f's.{k}' for k in keys)}, s.t AS date, {', '.join(f'{v} AS {names[k]}' for k, v in columns.items())} FROM spine s JOIN ev e ON {on} GROUP BY {', '.join(f's.{k}' for k in keys)}, s.t"
    shown_columns = ", ".join([*(f'{shown(m)} AS "{plain_name(m.name)}"' for m in wanted.measures), *combos])
    if base:
        return f"WITH {spine.replace('FROM ev', f'FROM {base}')} SELECT {listed}, date, {shown_columns} FROM ({inner.replace('JOIN ev e', f'JOIN {base} e')})"
    return sql(f"SELECT {listed}, date, {shown_columns} FROM ({inner})", spine)


def six_sql(x: str, prefix: str, names=("max", "min", "median", "mean", "std", "most_freq")) -> str:
    made = {"max": f"max({x})", "min": f"min({x})", "median": f"CAST(median({x}) AS DOUBLE)", "mean": f"avg({x})", "std": f"stddev_samp({x})"}
    wrapped = {"median", "mean", "std"}
    return ", ".join((six_digits(made[n]) if n in wrapped else made[n]) + f" AS {prefix}_{n}" for n in names)


def spread_sql(source: str, key: str, value: str, count_name: str, distinct_name: str, prefix: str, names) -> str:
    pairs = f"(SELECT *, CASE WHEN {value} IS NOT NULL THEN n END AS known FROM (SELECT {key}, {value}, count(*) AS n FROM {source} WHERE {key} IS NOT NULL GROUP BY ALL))"
    # the mode of counts, smallest first, by hand
    most = f"(SELECT {key}, known, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, known) AS r FROM {pairs} WHERE known IS NOT NULL GROUP BY {key}, known)"
    own = [n for n in names if n != "most_freq"]
    return f"SELECT p.*, m.known AS {prefix}_most_freq FROM (SELECT {key}, CAST(sum(n) AS BIGINT) AS {count_name}, count(known) AS {distinct_name}, {six_sql('known', prefix, own)} FROM {pairs} GROUP BY {key}) p LEFT JOIN (SELECT * FROM {most} WHERE r = 1) m ON p.{key} = m.{key}"


USAGE = ("min", "max", "median", "mean", "std", "most_freq")
VALUES = ("max", "mean", "median", "std", "most_freq")


def mode_sql(source: str, key: str, x: str, name: str) -> str:
    return f"SELECT {key}, {x} AS {name} FROM (SELECT {key}, {x}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {x}) AS r FROM {source} WHERE {x} IS NOT NULL AND {key} IS NOT NULL GROUP BY {key}, {x}) WHERE r = 1"


def six_with_mode(source: str, key: str, x: str, prefix: str) -> str:
    own = ("max", "min", "median", "mean", "std")
    return f"SELECT a.*, b.{prefix}_most_freq FROM (SELECT {key}, {six_sql(x, prefix, own).replace(f'max({x})', six_digits(f'max({x})')).replace(f'min({x})', six_digits(f'min({x})'))} FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}) a LEFT JOIN (SELECT {key}, round({prefix}_most_freq, 6) AS {prefix}_most_freq FROM ({mode_sql(source, key, x, f'{prefix}_most_freq')})) b USING ({key})"


def to_users_sql(source: str, key: str) -> str:
    return spread_sql(source, key, "user_id", "user_count", "user_nunique", "user_usage", USAGE)


def flags_sql(day: str) -> dict[str, str]:
    md = f"strftime({day}, '%m-%d')"
    out = {"is_holiday": f"{md} IN ({', '.join(map(repr, HOLIDAYS))})", "is_jiaban": f"{md} IN ({', '.join(map(repr, WORKDAYS))})", "is_month_start": f"day({day}) = 1", "is_month_end": f"{day} = last_day({day})"}
    return out | {f"is_weekday_{i}": f"isodow({day}) = {i}" for i in range(1, 8)}


def name_sql(day: str) -> str:
    f = flags_sql(day)
    parts = " || ".join(f"CASE WHEN {f[k]} THEN '{v}' ELSE '' END" for k, v in (("is_holiday", "吉"), ("is_jiaban", "班"), ("is_month_start", "月初"), ("is_month_end", "月末")))
    return f"CASE WHEN {day} IS NOT NULL THEN {parts} || '周' || isodow({day}) END"


RECEIVED = "(SELECT * FROM offline WHERE NOT label AND date_received IS NOT NULL AND coupon_id IS NOT NULL)"
USED = "(SELECT * FROM offline WHERE label AND date_received IS NOT NULL AND coupon_id IS NOT NULL)"
WITHOUT = "(SELECT * FROM offline WHERE NOT label AND coupon_id IS NULL)"
ONLINE_RECEIVED = "(SELECT * FROM online_coupon WHERE date IS NULL AND date_received IS NOT NULL AND coupon_id IS NOT NULL)"
ONLINE_USED = "(SELECT * FROM online_coupon WHERE date IS NOT NULL AND date_received IS NOT NULL AND coupon_id IS NOT NULL)"
OFFLINE12 = "(SELECT * REPLACE (coalesce(distance, 12) AS distance) FROM offline)"
SCORED = "scored AS (SELECT merchant_id, label, (user_id % 20) / 20.0::DOUBLE + coalesce(discount_rate, 0.0) / 2 AS prob FROM offline WHERE coupon_id IS NOT NULL)"
AUC = "CASE WHEN p * n > 0 THEN (rank_sum - p * (p + 1) / 2) / (p * n) END"
RANKED = "(SELECT *, rank() OVER ({0} ORDER BY prob) + (count(*) OVER ({1} prob) - 1) / 2.0 AS r FROM scored)"
CALENDAR = "calendar AS (SELECT DISTINCT date AS day FROM log)"


def between(column: str, bounds: tuple[str, str]) -> str:
    return f"{column} BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}'"


def rounds(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def usage_sql(source: str, key: str, prefix: str, subsets: dict[str, str]) -> str:
    """Outer-aligned usage statistics of subsets."""
    cols = ["user_count", "user_nunique", *(f"user_usage_{n}" for n in USAGE)]
    renamed = [f"(SELECT {key}, {', '.join(f'{c} AS {prefix}_{n}_{c}' for c in cols)} FROM ({to_users_sql(s.replace('offline', source) if source != 'offline' else s, key)}))" for n, s in subsets.items()]
    return f"SELECT * FROM {renamed[0]} FULL JOIN {renamed[1]} USING ({key})"


FULL = {"received_coupon": RECEIVED, "buy_with_coupon": USED}
FULL12 = {"received_coupon": RECEIVED.replace("* FROM", "* REPLACE (coalesce(distance, 12) AS distance) FROM"), "buy_with_coupon": USED.replace("* FROM", "* REPLACE (coalesce(distance, 12) AS distance) FROM")}


def profile_sql(source: str, kinds: dict[str, str]) -> str:
    """Of each column (name and Spark's name of its type): counts, bytes, ends, rarest and commonest value."""
    width = {"bigint": 8, "double": 8, "timestamp_ntz": 8, "date": 4, "boolean": 1}
    each = []
    for c, t in kinds.items():
        size = f"CAST(count(*) * {width[t]} AS BIGINT)" if t in width else f"CAST(coalesce(sum(strlen({c})), 0) AS BIGINT)"
        most = lambda order, c=c: f"(SELECT CAST({c} AS VARCHAR) FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*){order}, {c} LIMIT 1)"
        each.append(f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, {size} AS n_bytes, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, {most('')} AS rarest, {most(' DESC')} AS commonest FROM {source}")
    return " UNION ALL ".join(each)


def columns_of_offline() -> dict[str, str]:
    return {"user_id": "bigint", "merchant_id": "bigint", "coupon_id": "string", "distance": "double", "date_received": "date", "date": "date", "discount_name": "string", "is_dazhe": "boolean", "is_manjian": "boolean", "discount_man": "double", "discount_jian": "double", "discount_rate": "double", "label": "boolean"}


def catalogue_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{c.split('_', 1)[0]}' AS prefix, '{t}' AS data_type, count({c}) AS v FROM offline" for c, t in columns_of_offline().items())
    return sql(f"SELECT prefix, data_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS n_values FROM ({rows}) GROUP BY ALL")


INPUT_ROWS = """inputs AS (SELECT user_id, coupon_id, label, coalesce(distance, 0)::DOUBLE AS x0, coalesce(discount_rate, 0)::DOUBLE AS x1, coalesce(discount_man, 0)::DOUBLE AS x2,
  (isodow(date_received) - 1)::DOUBLE AS x3, month(date_received)::DOUBLE AS x4 FROM offline WHERE coupon_id IS NOT NULL)"""
FIVE = range(5)


def pca_sql(scale: bool, whiten: bool) -> str:
    """Two components of five inputs by power iteration, the second after the first is taken out."""
    unit = (lambda i: f"sd{i}") if scale else (lambda i: "1.0")
    names = [f"{c}{i}" for c in ("mean", "sd") for i in FIVE]
    moments = ", ".join([*(f"avg(x{i}) AS mean{i}, stddev_samp(x{i}) AS sd{i}" for i in FIVE), *(f"covar_samp(x{i}, x{j}) AS v{i}{j}" for i in FIVE for j in FIVE)])
    first = f"c1 AS (SELECT {', '.join(names)}, {', '.join(f'v{i}{j} / ({unit(i)} * {unit(j)}) AS c{i}{j}' for i in FIVE for j in FIVE)} FROM moments)"

    def turned(table: str, out: str) -> str:
        times = [" + ".join(f"c{i}{j} * p{j}" for j in FIVE) for i in FIVE]
        long_ = f"sqrt({' + '.join(f'power({t}, 2)' for t in times)})"
        step = ", ".join(f"({t}) / {long_} AS p{i}" for i, t in enumerate(times))
        signs = " ".join(f"WHEN abs(p{i}) = greatest({', '.join(f'abs(p{j})' for j in FIVE)}) THEN sign(p{i})" for i in FIVE)
        return f"""steps_{out} AS (SELECT 0 AS k, {', '.join(f'{1 + i / 7}::DOUBLE AS p{i}' for i in FIVE)} UNION ALL SELECT k + 1, {step} FROM steps_{out}, {table} WHERE k < 3000),
 {out} AS (SELECT {', '.join(f'p{i} * s AS {out}{i}' for i in FIVE)}, {' + '.join(f'p{i} * ({t})' for i, t in enumerate(times))} AS value_{out} FROM (SELECT *, CASE {signs} END AS s FROM steps_{out} WHERE k = 3000), {table})"""

    second = f"c2 AS (SELECT {', '.join(f'c{i}{j} - value_a * a{i} * a{j} AS c{i}{j}' for i in FIVE for j in FIVE)} FROM c1, a)"
    shown = [six_digits(f"({' + '.join(f'(x{i} - mean{i}) / {unit(i)} * {v}{i}' for i in FIVE)})" + f" / sqrt(value_{v})" * whiten) + f" AS pc_{n}" for n, v in enumerate("ab")]
    out = sql(f"SELECT user_id, coupon_id, {', '.join(shown)} FROM inputs, c1, a, b", ", ".join((INPUT_ROWS, f"moments AS (SELECT {moments} FROM inputs)", first, turned("c1", "a"), second, turned("c2", "b"))))
    return out.replace("WITH ", "WITH RECURSIVE ", 1)


def lda_sql() -> str:
    """The direction that parts the classes best: five equations, solved by taking out one unknown after the other."""
    sums = ", ".join([*(f"avg(x{i}) FILTER (WHERE label) - avg(x{i}) FILTER (WHERE NOT label) AS b{i}" for i in FIVE), *(f"(covar_pop(x{i}, x{j}) FILTER (WHERE label) * count(*) FILTER (WHERE label) + covar_pop(x{i}, x{j}) FILTER (WHERE NOT label) * count(*) FILTER (WHERE NOT label)) / (count(*) - 2) AS a{i}{j}" for i in FIVE for j in FIVE)])
    steps = [f"s0 AS (SELECT {sums} FROM inputs)"]
    for k in FIVE:
        own = [f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}" if i != k else f"a{i}{j}" for i in FIVE for j in FIVE] + [f"b{i} - a{i}{k} * b{k} / a{k}{k} AS b{i}" if i != k else f"b{i}" for i in FIVE]
        steps.append(f"s{k + 1} AS (SELECT {', '.join(own)} FROM s{k})")
    long_ = f"sqrt({' + '.join(f'power(b{i} / a{i}{i}, 2)' for i in FIVE)})"
    shown = six_digits(f"({' + '.join(f'x{i} * b{i} / a{i}{i}' for i in FIVE)}) / {long_}")
    return sql(f"SELECT user_id, coupon_id, label, {shown} AS ld FROM inputs, s5", ", ".join((INPUT_ROWS, *steps)))


def selector_sql() -> str:
    """Levels of merchants by hand: below the mean less a deviation in a cluster, then by the scores of all."""
    scores = "CAST(merchant_id % 4 AS VARCHAR) AS cluster, concat('f', merchant_id) AS feature, avg(discount_rate) AS s0, avg(user_id % 7) AS s1, avg((coupon_id IS NOT NULL)::INT) AS s2, avg(discount_man) AS s3, avg((date IS NOT NULL)::INT) AS s4, count(*)::DOUBLE AS s5"
    six = range(6)
    low = " OR ".join(f"s{i} < avg(s{i}) OVER c - stddev_samp(s{i}) OVER c" for i in six)

    def judged(table: str, sign: str, known: str) -> str:
        edge = lambda i, k: f"avg(s{i}) OVER () {'-' if sign == '<' else '+'} {k} * stddev_samp(s{i}) OVER ()"
        good, bad = f"coalesce(s0 {sign} {edge(0, 0)}, false)", " OR ".join(f"coalesce(s{i} {sign} {edge(i, 1)}, false)" for i in six[1:])
        return f"SELECT feature, CASE WHEN good THEN 'good' WHEN bad THEN 'bad' ELSE 'other' END AS level FROM {known} FULL JOIN (SELECT feature, {good} AS good, {bad} AS bad FROM {table}) USING (feature) WHERE good OR bad OR feature IN (SELECT feature FROM {known})"

    more = f"""clusters AS (SELECT {scores} FROM offline GROUP BY merchant_id), later AS (SELECT {scores} FROM online_coupon GROUP BY merchant_id),
 chosen AS (SELECT feature FROM clusters QUALIFY {low} WINDOW c AS (PARTITION BY cluster)), base AS (SELECT * FROM later WHERE feature IN (SELECT feature FROM chosen)), added AS (SELECT * FROM later WHERE feature NOT IN (SELECT feature FROM chosen))"""
    more = more.replace(f"QUALIFY {low} WINDOW c AS (PARTITION BY cluster)", "WINDOW c AS (PARTITION BY cluster) QUALIFY " + low)
    return sql(f"{judged('base', '<', 'chosen')} UNION {judged('added', '>', '(SELECT feature FROM clusters)')}", more)


#: Days of each window by hand, as differences between an event's day and the snapshot's, both clipped to the year.
HAND = {"future": "e.t >= least(s.t + 1, 365) AND e.t <= least(s.t + 30, 365)", "today": "e.t = s.t", "recent": "e.t >= greatest(s.t - 45, 0) AND e.t <= greatest(s.t - 16, 0)", "history": "e.t >= greatest(s.t - 75, 0) AND e.t <= greatest(s.t - 46, 0)", "longago": "e.t >= greatest(s.t - 180, 0) AND e.t <= greatest(s.t - 76, 0)"}
OFFLINE3, ONLINE4 = "('offline_receive_coupon', 'offline_buy_with_coupon', 'offline_buy_without_coupon')", "('online_receive_coupon', 'online_buy_with_coupon', 'online_buy_without_coupon', 'online_click')"


def hand_sql(key: str, columns: dict[str, str]) -> str:
    """Columns of each day of a key that occurs offline, written out; e is an event of the key, s the snapshot."""
    spine = f"(SELECT DISTINCT {key}, t FROM ev WHERE {key} IN (SELECT {key} FROM ev WHERE event_type IN {OFFLINE3})) s"
    return sql(f"SELECT s.{key}, s.t AS date, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {spine} JOIN ev e ON e.{key} = s.{key} GROUP BY s.{key}, s.t")


def hand_count(window: str, condition: str) -> str:
    return f"count(*) FILTER (WHERE {HAND[window]} AND {condition})"


def hand_values(window: str, kind: str, x: str, f: str) -> str:
    """0 without events, null where one lacks the value."""
    p = f"{HAND[window]} AND e.event_type = '{kind}'"
    return six_digits(f"CASE WHEN count(*) FILTER (WHERE {p}) = 0 THEN 0.0::DOUBLE WHEN count({x}) FILTER (WHERE {p}) = count(*) FILTER (WHERE {p}) THEN {f}({x}) FILTER (WHERE {p}) END")


def hand_often(window: str, kinds: str, x: str, least: int) -> str:
    text = f"coalesce(CAST(e.{x} AS VARCHAR), 'nan')"
    return f"coalesce(len(list_filter(map_values(histogram({text}) FILTER (WHERE {HAND[window]} AND e.event_type IN {kinds})), lambda c: c >= {least})), 0)"


RECEIVE_, USE_ = "e.event_type = 'offline_receive_coupon'", "e.event_type = 'offline_buy_with_coupon'"


def by_hand() -> dict[str, str]:
    """Each window, kind and step without the library's definitions."""
    out = {f"w_{w}": hand_sql("merchant_id", {f"{w}_offline_receive_coupon_count": hand_count(w, RECEIVE_)}) for w in ("future", "today")}
    out |= {f"w_{w}": hand_sql("merchant_id", {f"{w}_offline_receive_coupon_count": hand_count(w, RECEIVE_), f"{w}_offline_buy_with_coupon_count": hand_count(w, USE_)}) for w in ("recent", "history", "longago")}
    kinds = {"online": f"e.event_type IN {ONLINE4}", "offline": f"e.event_type IN {OFFLINE3}", **{k: f"e.event_type = '{k}'" for k in ("online_click", "online_receive_coupon", "online_buy_with_coupon", "online_buy_without_coupon", "offline_buy_without_coupon")}}
    use, receive = "offline_buy_with_coupon", "offline_receive_coupon"
    return out | {
        "op_kinds": hand_sql("user_id", {f"longago_{n}_count": hand_count("longago", p) for n, p in kinds.items()}),
        "clip_boundary": hand_sql("merchant_id", {f"{w}_offline_count": hand_count(w, kinds["offline"]) for w in ("future", "today", "recent", "history", "longago")}),
        "op_man200": hand_sql("user_id", {"recent_offline_receive_coupon_man200_count": hand_count("recent", f"{RECEIVE_} AND e.discount_man >= 200")}),
        "op_timedelta": hand_sql("merchant_id", {f"recent_{use}_timedelta_{n}": hand_values("recent", use, "e.timedelta", f) for n, f in (("mean", "avg"), ("max", "max"))}),
        "op_deltanow": hand_sql("user_id", {f"future_{receive}_deltanow_min": hand_values("future", receive, "(e.t - s.t)::DOUBLE", "min")}),
        "op_three_states": hand_sql("merchant_id", {f"recent_{use}_distance_{n}": hand_values("recent", use, "e.distance", f) for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))}),
        "op_discount_rate": hand_sql("user_id", {f"longago_{receive}_discount_rate_{n}": hand_values("longago", receive, "e.discount_rate", f) for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))}),
        "op_unique": hand_sql("merchant_id", {"recent_offline_unique_user_count": hand_often("recent", OFFLINE3, "user_id", 1), "recent_offline_unique_coupon_count": hand_often("recent", OFFLINE3, "coupon_id", 1), "history_offline_unique_merchant_count": hand_often("history", OFFLINE3, "merchant_id", 1)}),
        "op_hot": hand_sql("merchant_id", {"recent_offline_buy_without_coupon_unique_hotuser_count": hand_often("recent", "('offline_buy_without_coupon')", "user_id", 2), "longago_offline_unique_hotcoupon_count": hand_often("longago", OFFLINE3, "coupon_id", 3), "longago_offline_unique_hotuser_count": hand_often("longago", OFFLINE3, "user_id", 2)}),
    }


def registered_sql() -> str:
    """The registered steps by hand: windows as days, kinds as names."""
    inside = lambda a, b: f"e.t BETWEEN least(greatest(s.t - {a}, 0), 365) AND least(greatest(s.t - {b}, 0), 365)"
    recent, longago = inside(45, 16), inside(180, 76)
    used, received = "e.event_type = 'offline_buy_with_coupon'", "e.event_type = 'offline_receive_coupon'"
    rate = f"count(*) FILTER (WHERE {recent} AND {received})", f"count(*) FILTER (WHERE {recent} AND {received} AND e.discount_rate IS NULL)"
    click = f"count(*) FILTER (WHERE {longago} AND e.event_type = 'online_click')"
    inner = f"""SELECT s.user_id, s.t AS date, count(*) FILTER (WHERE {longago} AND {used} AND e.distance >= 5) AS far, count(*) FILTER (WHERE {longago} AND {used}) AS used,
 count(DISTINCT e.date) FILTER (WHERE {recent} AND e.event_type LIKE 'offline%') AS days, CASE WHEN {rate[0]} = 0 THEN 0.0 WHEN {rate[1]} = 0 THEN stddev_samp(e.discount_rate) FILTER (WHERE {recent} AND {received}) END AS rate,
 CASE WHEN {click} = 0 THEN 0.0 ELSE sum(e.click_count) FILTER (WHERE {longago} AND e.event_type = 'online_click') END AS clicks, coalesce(sum(e.t - s.t) FILTER (WHERE {recent} AND {received}), 0)::DOUBLE AS away
 FROM (SELECT DISTINCT user_id, t FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE event_type LIKE 'offline%')) s JOIN ev e ON e.user_id = s.user_id GROUP BY ALL"""
    return sql(f"""SELECT user_id, date, far AS longago_offline_buy_with_coupon_far_count, used AS longago_offline_buy_with_coupon_count, {six_digits('CASE WHEN used = 0 THEN 0.0 ELSE far::DOUBLE / used END')} AS "{plain_name('longago(offline_buy_with_coupon.far.count/offline_buy_with_coupon.count)')}",
 days AS recent_offline_unique_day_count, {six_digits('rate')} AS recent_offline_receive_coupon_discount_rate_std, {six_digits('clicks')} AS longago_online_click_clicks_sum, {six_digits('away')} AS recent_offline_receive_coupon_deltanow_sum FROM ({inner})""")


def merged_sql() -> str:
    """Label rows, and every feature of the five entities on (key, day)."""
    past = f"past AS (SELECT *, {LABEL} AS label FROM log WHERE {between('date', SPLIT.feature)} UNION ALL SELECT date, NULL, * EXCLUDE (date, date2), {LABEL} FROM log WHERE {between('date', SPLIT.test)} AND event_type = 'offline_receive_coupon')"
    ev2 = "ev2 AS MATERIALIZED (SELECT l.*, d.discount_rate, d.discount_man, dayofyear(date) - 1 AS t, CAST(dayofyear(date) - dayofyear(date2) AS DOUBLE) AS timedelta FROM past l LEFT JOIN discounts d USING (discount_name))"
    rows = f"rows_ AS (SELECT user_id, merchant_id, coupon_id, date AS d, dayofyear(date) - 1 AS date, distance, discount_name, label FROM past WHERE event_type = 'offline_receive_coupon' AND {between('date', SPLIT.train)})"
    tables, columns, joins = [], [], []
    for e in ("user", "merchant", "coupon", "user_merchant", "user_coupon"):
        tables.append(f"f_{e} AS ({features_sql(KEYS[e], features(e), 'ev2')})")
        joins.append(f"LEFT JOIN f_{e} ON {' AND '.join(f's.{k} = f_{e}.{k}' for k in (*KEYS[e], 'date'))}")
        columns += [f'f_{e}."{plain_name(n)}" AS "{plain_name(n) if e == "user_coupon" else f"{e}_{plain_name(n)}"}"' for n in features(e).names]
    fields = f"is_xianshi, is_dazhe, is_manjian, discount_man, discount_jian, {six_digits('d.discount_rate')} AS discount_rate"
    select = f"SELECT s.user_id, s.merchant_id, s.coupon_id, s.date, s.distance, s.label, {fields}, isodow(s.d) - 1 AS date_dayofweek, day(s.d) AS date_dayofmonth, {', '.join(columns)} FROM rows_ s LEFT JOIN discounts d USING (discount_name) {' '.join(joins)}"
    return sql(select, ", ".join((past, ev2, rows, *tables)))


LABEL = "coalesce(event_type = 'offline_receive_coupon' AND date2 - date <= 15, false)"


def active_sql() -> str:
    return sql("SELECT user_id, row_number() OVER (ORDER BY d DESC NULLS LAST, user_id) <= floor(count(*) OVER () * 0.2) AS is_active FROM (SELECT user_id, max(date) AS d FROM offline GROUP BY user_id)")


def oracle_sql() -> dict[str, str]:
    out = {
        "recent_conversion": features_sql(("user_id",), features("user").only(["recent.offline_buy_with_coupon.count", "recent.offline_receive_coupon.count", "recent(offline_buy_with_coupon.count/offline_receive_coupon.count)"])),
        "scan_offline": sql(f"SELECT * REPLACE ({rounds('discount_rate')}) FROM offline"),
        "scan_online_coupon": sql(f"SELECT * REPLACE ({rounds('discount_rate')}) FROM online_coupon"),
        "click_preagg": sql("SELECT * FROM clicks"),
        "raw_offline": sql(f"SELECT * REPLACE ({rounds('discount_rate')}) FROM offline"),
        "raw_online_coupon": sql(f"SELECT * REPLACE ({rounds('discount_rate')}) FROM online_coupon"),
        "raw_clicks": sql("SELECT * FROM clicks"),
        "raw_test": sql(f"SELECT user_id, merchant_id, coupon_id, distance, date_received, discount_name, is_dazhe, is_manjian, discount_man, discount_jian, {rounds('discount_rate')} FROM offline WHERE coupon_id IS NOT NULL AND {between('date_received', SPLIT.test)}"),
        "raw_test_events": sql(f"SELECT date_received AS date, CAST(NULL AS DATE) AS date2, 'offline_receive_coupon' AS event_type, user_id, merchant_id, coupon_id, discount_name, distance, CAST(NULL AS DOUBLE) AS click_count FROM offline WHERE coupon_id IS NOT NULL AND {between('date_received', SPLIT.test)}"),
        "events_csv": sql("SELECT * FROM log"),
        "discounts_csv": sql(f"SELECT * REPLACE ({rounds('discount_rate')}) FROM discounts"),
        "merchant_places": sql("SELECT merchant_id, n, row_number() OVER (ORDER BY n DESC, merchant_id) AS place, CAST(sum(n) OVER (ORDER BY n DESC, merchant_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto_n FROM (SELECT merchant_id, count(*) AS n FROM offline GROUP BY ALL)"),
        "sample_receipts": sql("SELECT merchant_id, user_id, coupon_id, date_received FROM offline WHERE coupon_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY md5(concat_ws('|', '7', merchant_id, user_id, coupon_id, date_received)), user_id, coupon_id, date_received) <= 3"),
        "lookup_user": sql("SELECT CAST(place AS INT) AS place, c AS column_name, v AS value FROM (SELECT *, row_number() OVER (ORDER BY date, event_type, merchant_id NULLS FIRST, coupon_id NULLS FIRST, distance NULLS FIRST) AS place FROM log WHERE user_id = 7), LATERAL (VALUES ('user_id', CAST(user_id AS VARCHAR)), ('date', CAST(date AS VARCHAR)), ('event_type', event_type), ('merchant_id', CAST(merchant_id AS VARCHAR)), ('coupon_id', coupon_id), ('distance', CAST(distance AS VARCHAR))) t(c, v)"),
        "lookup_counts": sql("SELECT event_type, count(*) AS n FROM log WHERE merchant_id = 1 GROUP BY ALL"),
        "op_registered": registered_sql(),
        "selector": selector_sql(),
        "rolling3_median": sql("SELECT merchant_id, date, n, CAST(r AS BIGINT) AS rolling FROM (SELECT *, median(n) OVER w AS r, count(*) OVER w AS c FROM (SELECT merchant_id, date, count(*) AS n FROM log GROUP BY ALL) WINDOW w AS (PARTITION BY merchant_id ORDER BY date ROWS 2 PRECEDING)) WHERE c = 3"),
        "longest_gaps_by_function": sql("SELECT merchant_id, count(*) AS n, CAST(max(gap) AS INT) AS longest FROM (SELECT merchant_id, date - lag(date) OVER (PARTITION BY merchant_id ORDER BY date) AS gap FROM log WHERE event_type = 'offline_receive_coupon') GROUP BY ALL"),
        "pca2": pca_sql(scale=False, whiten=True),
        "scaled_pca": pca_sql(scale=True, whiten=False),
        "lda1": lda_sql(),
        "parse_discount": sql(f"SELECT discount AS text, discount_name, is_xianshi, is_dazhe, is_manjian, discount_man, discount_jian, {rounds('discount_rate')} FROM sample_typed", "sample AS (SELECT DISTINCT discount FROM (SELECT discount FROM kept UNION ALL SELECT unnest(['fixed', '150:20', '0.9', '95', '0.29', '0.58', '1', '200:50', NULL]))), " + discount_sql("sample", "sample_typed")),
        "discount_dim": sql(f"SELECT * REPLACE ({rounds('discount_rate')}) FROM discounts"),
        "select_label": sql(f"SELECT * REPLACE ({rounds('discount_rate')}) FROM offline WHERE coupon_id IS NOT NULL AND {between('date_received', LABELS)}"),
        "select_feature": sql(f"SELECT * REPLACE ({rounds('discount_rate')}) FROM offline WHERE (date_received IS NULL OR {between('date_received', FEATURES)}) AND (date IS NULL OR {between('date', FEATURES)})"),
        "select_received": sql(f"SELECT user_id, coupon_id, date_received, date FROM {RECEIVED}"),
        "select_buy_with": sql(f"SELECT user_id, coupon_id, date_received, date FROM {USED}"),
        "select_buy_without": sql(f"SELECT user_id, merchant_id, date FROM {WITHOUT}"),
        "event_type_case": sql("SELECT CASE WHEN coupon_id IS NULL OR date_received IS NULL THEN 'buy_without_coupon' WHEN date IS NOT NULL THEN 'buy_with_coupon' ELSE 'receive_coupon' END AS kind, count(*) AS n FROM offline GROUP BY ALL"),
        "event_fanout": sql("SELECT * EXCLUDE (click_count) FROM log WHERE event_type LIKE 'offline%'"),
        "events_union": sql("SELECT * FROM log"),
        "events_label": sql(f"SELECT event_type, {LABEL} AS label, count(*) AS n FROM log GROUP BY ALL"),
        "events_split": sql(f"SELECT date, date2, event_type, user_id, merchant_id, coupon_id, {LABEL} AS label FROM log WHERE {between('date', SPLIT.feature)} UNION ALL SELECT date, NULL, event_type, user_id, merchant_id, coupon_id, {LABEL} FROM log WHERE {between('date', SPLIT.test)} AND event_type = 'offline_receive_coupon'"),
        "test_events": sql("SELECT date_received AS date, CAST(NULL AS DATE) AS date2, 'offline_receive_coupon' AS event_type, user_id, coupon_id FROM offline WHERE coupon_id IS NOT NULL"),
        "wide_flags": sql("SELECT event_type, event_type LIKE 'offline%' AS is_offline, event_type LIKE '%receive_coupon' OR event_type LIKE '%with_coupon' AS is_coupon, event_type LIKE '%buy%' AS is_buy, count(*) AS n, CAST(sum(dayofyear(date) - 1) AS BIGINT) AS sum_t, CAST(sum(dayofyear(date2) - 1) AS BIGINT) AS sum_t2 FROM log GROUP BY ALL"),
        "dropna_keys": sql("SELECT user_id, coupon_id, event_type, date FROM log WHERE user_id IS NOT NULL AND coupon_id IS NOT NULL"),
        "fill_by_type": sql("SELECT user_id, coalesce(distance, 0) AS distance, coalesce(discount_jian, 0) AS discount_jian, coalesce(is_manjian, false) AS is_manjian, coalesce(label, false) AS label FROM offline"),
        "predict_rows": sql(f"SELECT user_id, coupon_id, date_received, {name_sql('date_received')} AS date_received_name, {flags_sql('date_received')['is_holiday']} AS date_received_is_holiday, {flags_sql('date_received')['is_weekday_7']} AS date_received_is_weekday_7 FROM offline WHERE coupon_id IS NOT NULL AND date_received IS NOT NULL"),
        "left_discount": sql(f"SELECT event_type, user_id, date, discount_name, {rounds('discount_rate')}, discount_man FROM ev"),
        "left_discount_sql": sql("SELECT event_type, count(*) AS n, count(discount_rate) AS n_rate, round(sum(discount_rate), 6) AS total FROM ev GROUP BY ALL"),
        "inner_discount": sql(f"SELECT discount_name, count(*) AS n, round(first(d.discount_rate), 6) AS discount_rate FROM log JOIN discounts d USING (discount_name) GROUP BY discount_name"),
        "semi_known_users": sql(f"SELECT user_id, count(*) AS n FROM online_coupon WHERE {KNOWN} GROUP BY ALL"),
        "outer_align": sql(f"SELECT coupon_id, received, used FROM (SELECT coupon_id, count(*) AS received FROM {RECEIVED} GROUP BY ALL) FULL JOIN (SELECT coupon_id, count(*) AS used FROM {USED} GROUP BY ALL) USING (coupon_id)"),
        "id_coverage": sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM offline) AS n_own, count(*) AS n_total, count(*) FILTER (WHERE missing) AS n_missing, round(count(*) FILTER (WHERE missing)::DOUBLE / count(*), 6) AS miss_ratio, (SELECT coalesce(string_agg(c, ',' ORDER BY md5('0|' || c)), '') FROM (SELECT CAST({c} AS VARCHAR) AS c FROM (SELECT DISTINCT {c} FROM online_coupon WHERE {c} IS NOT NULL) WHERE {c} NOT IN (SELECT {c} FROM offline WHERE {c} IS NOT NULL) ORDER BY md5('0|' || CAST({c} AS VARCHAR)) LIMIT 4)) AS missing FROM (SELECT DISTINCT {c}, {c} NOT IN (SELECT {c} FROM offline WHERE {c} IS NOT NULL) AS missing FROM online_coupon WHERE {c} IS NOT NULL)" for c in ("user_id", "coupon_id"))),
        "id_difference": sql("SELECT user_id FROM online_coupon EXCEPT SELECT user_id FROM offline"),
        "big_merchant_split": sql("SELECT merchant_id, n FROM placed WHERE place <= (SELECT ceil(min(place) / 5.0) * 5 FROM placed WHERE upto > 0.8 * (SELECT sum(n) FROM counted))", "counted AS (SELECT merchant_id, count(*) AS n FROM offline GROUP BY ALL), placed AS (SELECT *, row_number() OVER (ORDER BY n DESC, merchant_id) AS place, sum(n) OVER (ORDER BY n DESC, merchant_id ROWS UNBOUNDED PRECEDING) AS upto FROM counted)"),
        "feat_merged": merged_sql(),
        "top20_active": active_sql(),
        "user_merchant_stats": sql(spread_sql("offline", "user_id", "merchant_id", "merchant_count", "merchant_nunique", "merchant_value_count", VALUES)),
        **{f"to_user_stats_{n}": sql(to_users_sql("offline", k)) for n, k in (("merchant", "merchant_id"), ("coupon", "coupon_id"), ("discount", "discount_name"), ("distance", "distance"))},
        "discount_stats": sql(f"""SELECT * FROM ({spread_sql('offline', 'merchant_id', 'coupon_id', 'coupon_count', 'coupon_nunique', 'coupon_value_count', VALUES)})
 JOIN ({six_with_mode('offline', 'merchant_id', 'discount_man', 'discount_man')}) USING (merchant_id) JOIN ({six_with_mode('offline', 'merchant_id', 'discount_jian', 'discount_jian')}) USING (merchant_id)
 JOIN ({six_with_mode('offline', 'merchant_id', 'discount_rate', 'discount_rate')}) USING (merchant_id)
 JOIN (SELECT merchant_id, count(*) FILTER (WHERE is_manjian) AS manjian_count, count(*) FILTER (WHERE is_dazhe) AS dazhe_count FROM offline GROUP BY ALL) USING (merchant_id)
 LEFT JOIN (SELECT merchant_id, round(k::DOUBLE / u, 6) AS transfer_rate FROM (SELECT merchant_id, count(*) AS k FROM {RECEIVED} GROUP BY ALL) FULL JOIN (SELECT merchant_id, count(*) AS u FROM {USED} GROUP BY ALL) USING (merchant_id)) USING (merchant_id)"""),
        "distance_stats": sql(six_with_mode("offline", "merchant_id", "distance", "distance")),
        "date_any": sql(f"SELECT user_id, {', '.join(f'coalesce(bool_or({flags_sql(chr(100) + 'ate')[f]}), false) AS date_{f}' for f in DATE_FLAGS)} FROM offline GROUP BY user_id"),
        "hold_days_stats": sql(six_with_mode("(SELECT user_id, CAST(date - date_received AS DOUBLE) AS held FROM offline)", "user_id", "held", "coupon_hold_days")),
        "click_stats": sql("SELECT user_id, max(count) AS click_count_max, CAST(median(count) AS DOUBLE) AS click_count_median FROM clicks GROUP BY user_id"),
        "transfer_rate": sql(f"SELECT merchant_id, a AS merchant_offline_received_coupon_coupon_count, b AS merchant_offline_buy_with_coupon_coupon_count, round(b::DOUBLE / a, 6) AS merchant_offline_transfer_rate_received_coupon_coupon_count_to_buy_with_coupon_coupon_count FROM (SELECT merchant_id, count(*) AS a FROM {RECEIVED} GROUP BY ALL) FULL JOIN (SELECT merchant_id, count(*) AS b FROM {USED} GROUP BY ALL) USING (merchant_id) FULL JOIN (SELECT DISTINCT merchant_id FROM {WITHOUT}) USING (merchant_id)"),
        "mode_tie": sql(f"SELECT merchant_id, distance, discount_name FROM (SELECT DISTINCT merchant_id FROM offline) LEFT JOIN ({mode_sql('offline', 'merchant_id', 'distance', 'distance')}) USING (merchant_id) LEFT JOIN ({mode_sql('offline', 'merchant_id', 'discount_name', 'discount_name')}) USING (merchant_id)"),
        "classic_user": sql(f"SELECT * FROM {user_sql()[0]}"),
        "classic_merchant": sql(f"SELECT * FROM {merchant_sql()[0]}"),
        "classic_coupon": sql(usage_sql("offline", "coupon_id", "coupon_offline", FULL)),
        "classic_distance": sql(usage_sql("offline", "distance", "distance_offline", FULL12)),
        "classic_discount": sql(f"SELECT * FROM {discount_features_sql()[0]}"),
        "classic_merged": classic_merged_sql(),
        "key_distinct_single": sql("SELECT DISTINCT coupon_id FROM log WHERE coupon_id IS NOT NULL"),
        "key_distinct_multi": sql("SELECT DISTINCT user_id, coupon_id FROM log WHERE coupon_id IS NOT NULL AND user_id IS NOT NULL"),
        "quantiles": sql("SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS q, unnest(v) AS value FROM (SELECT quantile_cont(n::DOUBLE, [0.5, 0.9, 0.99]) AS v FROM (SELECT count(*) AS n FROM offline WHERE coupon_id IS NOT NULL GROUP BY coupon_id))"),
        "value_counts": sql("SELECT discount_name, count(*) AS n FROM offline WHERE discount_name IS NOT NULL GROUP BY ALL"),
        "histogram": sql("SELECT CAST(least(floor((discount_rate - lo) / (hi - lo) * 10), 9) AS INT) AS bin, count(*) AS n FROM offline, (SELECT min(discount_rate) AS lo, max(discount_rate) AS hi FROM offline) WHERE discount_rate IS NOT NULL GROUP BY ALL"),
        "profile_table": sql(profile_sql("offline", {"user_id": "bigint", "coupon_id": "string", "distance": "double", "date": "date", "discount_name": "string"})),
        "profile_events": profile_sql("events", {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}),
        "null_audit": sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, bool_or({c} IS NULL) AS has_null FROM offline" for c in columns_of_offline())),
        "schema_catalogue": catalogue_sql(),
        "confusion": sql("SELECT prob > 0.8 AS predicted, count(*) FILTER (WHERE NOT label) AS label_false, count(*) FILTER (WHERE label) AS label_true FROM scored GROUP BY ALL", SCORED),
        **{n: features_sql((k,), parse(t)) for n, (k, t) in OPERATORS.items()},
        **by_hand(),
        **{f"feat_{e}": features_sql(KEYS[e], features(e)) for e in KEYS},
        "rolling3_sum": sql("SELECT merchant_id, date, n, CAST(r AS BIGINT) AS rolling FROM (SELECT *, sum(n) OVER w AS r, count(*) OVER w AS c FROM (SELECT merchant_id, date, count(*) AS n FROM log GROUP BY ALL) WINDOW w AS (PARTITION BY merchant_id ORDER BY date ROWS 2 PRECEDING)) WHERE c = 3"),
        "date_vector": sql(f"SELECT day, {name_sql('day')} AS day_name, {', '.join(f'{v} AS day_{k}' for k, v in flags_sql('day').items())} FROM calendar", CALENDAR),
        "day_ordinal": sql(f"SELECT day, CAST(dayofyear(day) - 1 AS INT) AS t, day AS back FROM calendar", CALENDAR),
        "date_parts": sql(f"SELECT day, CAST(isodow(day) - 1 AS INT) AS date_dayofweek, CAST(day(day) AS INT) AS date_dayofmonth FROM calendar", CALENDAR),
        "date_format": sql(f"SELECT day, strftime(day, '%Y%m%d') AS text, day AS back FROM calendar", CALENDAR),
        "hash_partition": sql("SELECT CAST(CAST(concat('0x', substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 8 AS BIGINT) AS bucket, count(*) AS n FROM offline GROUP BY ALL"),
        "topk_merchant": sql("SELECT merchant_id, count(*) AS n FROM offline GROUP BY ALL ORDER BY n DESC, merchant_id LIMIT 10"),
        "row_number": sql("SELECT order_id, line, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line) AS INT) AS row FROM kept"),
        "union_all": sql("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM offline UNION ALL SELECT user_id FROM online_coupon) GROUP BY ALL"),
        "side_by_side": sql("SELECT CAST(place AS INT) AS place, merchant_id, n, other_id, m FROM (SELECT merchant_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, merchant_id) AS place FROM offline GROUP BY merchant_id) FULL JOIN (SELECT merchant_id AS other_id, count(*) AS m, row_number() OVER (ORDER BY count(*) DESC, merchant_id) AS place FROM online_coupon GROUP BY merchant_id) USING (place) WHERE place <= 5"),
        "multi_key_sort": sql("SELECT user_id, merchant_id, date_received FROM offline ORDER BY user_id, merchant_id, date_received DESC"),
        "auc_global": sql(f"SELECT round({AUC}, 6) AS auc FROM (SELECT sum(r) FILTER (WHERE label) AS rank_sum, count(*) FILTER (WHERE label)::DOUBLE AS p, count(*) FILTER (WHERE NOT label)::DOUBLE AS n FROM {RANKED.format('', 'PARTITION BY')})", SCORED),
        "auc_per_group": sql(f"SELECT merchant_id, round({AUC}, 6) AS auc FROM (SELECT merchant_id, sum(r) FILTER (WHERE label) AS rank_sum, count(*) FILTER (WHERE label)::DOUBLE AS p, count(*) FILTER (WHERE NOT label)::DOUBLE AS n FROM {RANKED.format('PARTITION BY merchant_id', 'PARTITION BY merchant_id,')} GROUP BY merchant_id)", SCORED),
        "mean_group_auc": sql(f"SELECT round(avg(auc), 6) AS mean_auc, count(auc) AS n_groups FROM (SELECT {AUC} AS auc FROM (SELECT merchant_id, sum(r) FILTER (WHERE label) AS rank_sum, count(*) FILTER (WHERE label)::DOUBLE AS p, count(*) FILTER (WHERE NOT label)::DOUBLE AS n FROM {RANKED.format('PARTITION BY merchant_id', 'PARTITION BY merchant_id,')} GROUP BY merchant_id))", SCORED),
        "error_slices": sql("SELECT merchant_id, count(*) AS n FROM scored WHERE prob > 0.8 AND NOT label GROUP BY ALL", SCORED),
        "feature_selection_sigma": sql("SELECT merchant_id, n, CASE WHEN n > m + s THEN 'high' WHEN n < m - s THEN 'low' ELSE 'middle' END AS level FROM (SELECT merchant_id, count(*) AS n FROM offline GROUP BY ALL), (SELECT avg(n) AS m, stddev_samp(n) AS s FROM (SELECT count(*) AS n FROM offline GROUP BY merchant_id))"),
        "held_out": sql(f"SELECT CASE WHEN date >= DATE '1996-09-15' THEN 'test' WHEN CAST(concat('0x', substr(md5(concat_ws('|', user_id, coalesce(coupon_id, ''), date)), 1, 8)) AS BIGINT) % 10000 < 2000 THEN 'validate' ELSE 'train' END AS part, user_id, merchant_id, coupon_id, date, {LABEL} AS label FROM log WHERE event_type = 'offline_receive_coupon' AND ({between('date', SPLIT.train)} OR {between('date', SPLIT.test)})"),
        "submit_by_leaf_checks": sql(f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_bad, true AS better_than_chance FROM log WHERE event_type = 'offline_receive_coupon' AND {between('date', SPLIT.test)}"),
        "submit_checks": sql(f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_bad, true AS better_than_chance FROM log WHERE event_type = 'offline_receive_coupon' AND {between('date', SPLIT.test)}"),
        "receive_days_per_merchant": sql("SELECT DISTINCT merchant_id, date FROM log WHERE event_type = 'offline_receive_coupon'"),
        "receive_days_by_function": sql("SELECT DISTINCT merchant_id, date FROM log WHERE event_type = 'offline_receive_coupon'"),
        "events_by_day": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    }
    return out


Table = tuple[str, list[str]]  # a bracketed SELECT with a key, and its other columns
SPREAD = {"merchant_id": ("merchant_count", "merchant_nunique", "merchant_value_count", VALUES), "user_id": ("user_count", "user_nunique", "user_usage", USAGE), "coupon_id": ("coupon_count", "coupon_nunique", "coupon_value_count", VALUES)}
SIX = ("max", "min", "median", "mean", "std", "most_freq")


def spread_table(source: str, key: str, value: str) -> Table:
    count, distinct, prefix, names = SPREAD[value]
    return f"({spread_sql(source, key, value, count, distinct, prefix, names)})", [count, distinct, *(f"{prefix}_{n}" for n in names)]


def six_table(source: str, key: str, x: str, prefix: str) -> Table:
    return f"({six_with_mode(f'(SELECT {key}, {x} AS v FROM {source})', key, 'v', prefix)})", [f"{prefix}_{n}" for n in SIX]


def dates_table(source: str, key: str, day: str) -> Table:
    flags = flags_sql(day)
    return f"(SELECT {key}, {', '.join(f'coalesce(bool_or({flags[f]}), false) AS {day}_{f}' for f in DATE_FLAGS)} FROM {source} WHERE {key} IS NOT NULL GROUP BY {key})", [f"{day}_{f}" for f in DATE_FLAGS]


def rate_table(source: str, key: str, used: str) -> Table:
    known = "coupon_id IS NOT NULL AND date_received IS NOT NULL"
    return f"(SELECT {key}, round(k::DOUBLE / u, 6) AS transfer_rate FROM (SELECT {key}, count(*) FILTER (WHERE NOT ({used}) AND {known}) AS k, count(*) FILTER (WHERE {used} AND {known}) AS u FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}) WHERE k > 0 AND u > 0)", ["transfer_rate"]


def discount_tables(source: str, key: str, used: str) -> list[Table]:
    return [spread_table(source, key, "coupon_id"), *(six_table(source, key, c, c) for c in ("discount_man", "discount_jian", "discount_rate")), rate_table(source, key, used)]


def hold_table(source: str, key: str) -> Table:
    return six_table(source, key, "CAST(date - date_received AS DOUBLE)", "coupon_hold_days")


def together(tables: list[Table], key: str, prefix: str = "") -> Table:
    """All groups of several tables, their columns with a prefix."""
    joins = tables[0][0] + " t0" + "".join(f" FULL JOIN {t} t{i} USING ({key})" for i, (t, _) in enumerate(tables[1:], 1))
    names = [n for _, own in tables for n in own]
    return f"(SELECT {key}, {', '.join(f't{i}.{n} AS {prefix}{n}' for i, (_, own) in enumerate(tables) for n in own)} FROM {joins})", [prefix + n for n in names]


def active_table(source: str, day: str, prefix: str) -> Table:
    return f"(SELECT user_id, row_number() OVER (ORDER BY d DESC NULLS LAST, user_id) <= floor(count(*) OVER () * 0.2) AS {prefix}_{day}_is_active FROM (SELECT user_id, max({day}) AS d FROM {source} GROUP BY user_id))", [f"{prefix}_{day}_is_active"]


def user_sql(offline: str = "offline", clicks: str = "clicks", online: str = "online_coupon") -> Table:
    near = f"(SELECT * REPLACE (coalesce(distance, 12) AS distance) FROM {offline})"
    rest = lambda s: [hold_table(s, "user_id"), dates_table(s, "user_id", "date_received"), dates_table(s, "user_id", "date"), spread_table(s, "user_id", "merchant_id")]
    clicked = f"(SELECT user_id, max(count) AS click_count_max, CAST(median(count) AS DOUBLE) AS click_count_median FROM {clicks} GROUP BY user_id)", ["click_count_max", "click_count_median"]
    return together([
        together([*discount_tables(near, "user_id", "label"), *rest(near), six_table(near, "user_id", "distance", "distance")], "user_id", "user_offline_"),
        active_table(offline, "date", "user_offline"), active_table(offline, "date_received", "user_offline"),
        together([clicked, spread_table(clicks, "user_id", "merchant_id"), dates_table(clicks, "user_id", "date")], "user_id", "user_online_click_"), active_table(clicks, "date", "user_online_click"),
        together([*discount_tables(online, "user_id", "date IS NOT NULL"), *rest(online)], "user_id", "user_online_coupon_"),
        active_table(online, "date", "user_online_coupon"), active_table(online, "date_received", "user_online_coupon"),
    ], "user_id")


def merchant_sql(offline: str = "offline") -> Table:
    key = "merchant_id"
    near = f"(SELECT * REPLACE (coalesce(distance, 12) AS distance) FROM {offline})"
    received, used, without = (x.replace("offline", near) for x in (RECEIVED, USED, WITHOUT))
    far = lambda s: six_table(s, key, "distance", "distance")
    parts = [
        together([*discount_tables(received, key, "label"), dates_table(received, key, "date_received"), spread_table(received, key, "user_id")], key, "received_coupon_"),
        together([*discount_tables(used, key, "label"), hold_table(used, key), dates_table(used, key, "date_received"), dates_table(used, key, "date"), far(used), spread_table(used, key, "user_id")], key, "buy_with_coupon_"),
        together([dates_table(without, key, "date"), far(without), spread_table(without, key, "user_id")], key, "buy_without_coupon_"),
    ]
    whole, names = together(parts, key, "merchant_offline_")
    a, b, rate = (f"merchant_offline_{n}" for n in ("received_coupon_coupon_count", "buy_with_coupon_coupon_count", "transfer_rate_received_coupon_coupon_count_to_buy_with_coupon_coupon_count"))
    return f"(SELECT *, round({b}::DOUBLE / {a}, 6) AS {rate} FROM {whole})", [*names, rate]


def usage_table(source: str, key: str, prefix: str, used: str) -> Table:
    known = "coupon_id IS NOT NULL AND date_received IS NOT NULL"
    subsets = (("received_coupon_", f"NOT ({used})"), ("buy_with_coupon_", used))
    return together([together([spread_table(f"(SELECT * FROM {source} WHERE {p} AND {known})", key, "user_id")], key, n) for n, p in subsets], key, prefix)


def discount_features_sql(offline: str = "offline", online: str = "online_coupon") -> Table:
    return together([usage_table(offline, "discount_name", "discount_offline_", "label"), usage_table(online, "discount_name", "discount_online_", "date IS NOT NULL")], "discount_name")


def classic_merged_sql() -> str:
    kept = lambda *days: " AND ".join(f"({d} IS NULL OR {between(d, FEATURES)})" for d in days)
    views = [f"past AS (SELECT * FROM offline WHERE {kept('date_received', 'date')})", f"past_online AS (SELECT * FROM online_coupon WHERE {kept('date_received', 'date')})", f"past_clicks AS (SELECT * FROM clicks WHERE {kept('date')})"]
    near = "(SELECT * REPLACE (coalesce(distance, 12) AS distance) FROM past)"
    tables = [
        ("user_id", user_sql("past", "past_clicks", "past_online")), ("merchant_id", merchant_sql("past")), ("coupon_id", usage_table("past", "coupon_id", "coupon_offline_", "label")),
        ("discount_name", discount_features_sql("past", "past_online")), ("distance", usage_table(near, "distance", "distance_offline_", "label")),
    ]
    joins = " ".join(f"LEFT JOIN {t} e{i} ON r.{k} = e{i}.{k}" for i, (k, (t, _)) in enumerate(tables))
    flag = lambda n: "_is_" in n
    filled = ", ".join(f"coalesce(e{i}.{n}, {'false' if flag(n) else 0}) AS {n}" for i, (_, (_, own)) in enumerate(tables) for n in own)
    rows = f"(SELECT user_id, merchant_id, coupon_id, discount_name, date_received, distance, label FROM offline WHERE coupon_id IS NOT NULL AND {between('date_received', LABELS)})"
    return sql(f"SELECT r.* REPLACE (coalesce(distance, 12) AS distance), {filled} FROM (SELECT * FROM {rows}) r {joins}".replace("coalesce(distance, 12) AS distance), coalesce(e0", "coalesce(r.distance, 12) AS distance), coalesce(e0"), ", ".join(views))
