"""The feature language: lines of text, each of which names a feature.

`window.step.step.aggregate` counts or measures the events of a window; `window(left - right)` and
`window(left / right)` combine two of those. A line may have a comment after #; spaces don't matter.

What a step means stands in a registry, as SQL over the columns of an event and, for aggregates, how a day's parts are
put together over days. A caller's own steps join the library's by `STEPS.plus(...)`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from ..schema import KINDS, OFFLINE_KINDS, ONLINE_KINDS

#: First and last day of each window, relative to the snapshot's day.
WINDOWS = {"future": (1, 30), "today": (0, 0), "recent": (-45, -16), "history": (-75, -46), "longago": (-180, -76)}


@dataclass(frozen=True)
class Filter:
    """Which events count: those of some kinds, and those that meet a condition."""

    name: str
    condition: str | None = None
    kinds: tuple[str, ...] = KINDS


@dataclass(frozen=True)
class Value:
    """What of an event is measured. relative: a day, which is told from the snapshot's day."""

    name: str
    sql: str
    relative: bool = False


@dataclass(frozen=True)
class Distinct:
    """Of what distinct values count, and how often a value must occur to count. A missing one is a value."""

    name: str
    sql: str
    least: int = 1


@dataclass(frozen=True)
class Aggregate:
    """A number made of parts that are kept by key and day.

    parts: for each letter the aggregate of a day's values {x} and the one that puts days together. whole: the number,
    from the letters in braces, {n} values (never 0) and the snapshot's day t. shift: what it grows by where all values
    grow by t. n (how many), z (how many are missing), s, l and h are the library's letters.
    """

    name: str
    whole: str
    parts: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    shift: str = "t"


Step = Filter | Value | Distinct | Aggregate


@dataclass(frozen=True)
class Steps:
    """The steps that texts may name."""

    by_name: Mapping[str, Step]

    def plus(self, *more: Step) -> Steps:
        """These steps and more; ValueError for a name that is taken, or a letter that means something else."""
        out = dict(self.by_name)
        for s in more:
            if s.name in out or s.name in WINDOWS or not s.name.isidentifier():
                raise ValueError(f"not a new step: {s.name}")
            if isinstance(s, Aggregate):
                others = {k: v for x in out.values() if isinstance(x, Aggregate) for k, v in x.parts.items()}
                clash = sorted(k for k, v in s.parts.items() if k in "nz" or others.get(k, v) != v)
                if clash:
                    raise ValueError(f"parts that mean something else: {clash}")
            out[s.name] = s
        return Steps(out)

    def get(self, name: str, kind: type) -> Step | None:
        s = self.by_name.get(name)
        return s if isinstance(s, kind) else None

    def parts(self) -> dict[str, tuple[str, str]]:
        return {k: v for s in self.by_name.values() if isinstance(s, Aggregate) for k, v in s.parts.items()}


TOTAL, LEAST, LARGEST = ("sum({x})", "sum"), ("min({x})", "min"), ("max({x})", "max")
STEPS = Steps({}).plus(
    *(Filter(k, kinds=(k,)) for k in KINDS), Filter("offline", kinds=OFFLINE_KINDS), Filter("online", kinds=ONLINE_KINDS), Filter("man200", "discount_man >= 200"),
    *(Value(v, v) for v in ("discount_rate", "distance", "timedelta")), Value("deltanow", "CAST(t AS DOUBLE)", relative=True),
    Distinct("unique_user", "user_id"), Distinct("unique_merchant", "merchant_id"), Distinct("unique_coupon", "coupon_id"), Distinct("unique_hotuser", "user_id", 2), Distinct("unique_hotcoupon", "coupon_id", 3),
    Aggregate("count", "{n}"), Aggregate("min", "{l}", {"l": LEAST}), Aggregate("max", "{h}", {"h": LARGEST}), Aggregate("mean", "{s} / {n}", {"s": TOTAL}),
)


@dataclass(frozen=True)
class Measure:
    """One calculation: which events, what of them, and how it is put together. filters: those that aren't kinds alone."""

    name: str
    window: str
    kinds: tuple[str, ...]
    filters: tuple[str, ...]
    value: str | None
    distinct: str | None
    aggregate: str


@dataclass(frozen=True)
class Combination:
    name: str
    operator: str
    left: str
    right: str


@dataclass(frozen=True)
class Features:
    """What a text defines: calculations, combinations, and the order of the lines."""

    measures: tuple[Measure, ...]
    combinations: tuple[Combination, ...]
    order: tuple[str, ...] = ()
    steps: Steps = STEPS

    @property
    def names(self) -> list[str]:
        known = [x.name for x in (*self.measures, *self.combinations)]
        return [n for n in self.order if n in set(known)] or known

    def only(self, wanted) -> Features:
        """The wanted features, and the calculations that their combinations need."""
        wanted = set(wanted)
        combos = tuple(c for c in self.combinations if c.name in wanted)
        needed = wanted | {x for c in combos for x in (c.left, c.right)}
        return replace(self, measures=tuple(m for m in self.measures if m.name in needed), combinations=combos)


def measure(path: str, steps: Steps = STEPS) -> Measure:
    window, *own, last = path.split(".")
    kinds, filters, value, distinct = KINDS, [], None, None
    for name in own:
        s = steps.by_name[name]
        if isinstance(s, Filter):
            kinds = tuple(k for k in kinds if k in s.kinds)
            filters += [name] if s.condition else []
        elif isinstance(s, Value):
            value = name
        elif isinstance(s, Distinct):
            distinct = name
    return Measure(path, window, kinds, tuple(sorted(set(filters))), value, distinct, last)


def parse(text: str, steps: Steps = STEPS) -> Features:
    """Features of a definition text; ValueError for unknown steps and for operands that aren't defined."""
    paths, combos, order = [], [], []
    for line in text.splitlines():
        line = line.partition("#")[0].replace(" ", "")
        if not line:
            continue
        order.append(line)
        if not line.endswith(")"):
            paths.append(line)
            continue
        window, _, inside = line[:-1].partition("(")
        sign = "-" if "-" in inside else "/"
        left, found, right = inside.partition(sign)
        if not found:
            raise ValueError(f"not a combination: {line}")
        combos.append(Combination(line, sign, f"{window}.{left}", f"{window}.{right}"))
    missing = sorted({s for p in [*paths, *(x for c in combos for x in (c.left, c.right))] for s in p.split(".")} - {*WINDOWS, *steps.by_name})
    if missing:
        raise ValueError(f"missing ops: {missing}")
    for p in paths:
        head, *inner, last = p.split(".")
        if head not in WINDOWS or not steps.get(last, Aggregate) or any(steps.get(s, Aggregate) or s in WINDOWS for s in inner):
            raise ValueError(f"a feature starts with a window and ends with an aggregate: {p}")
        if last != "count" and not any(steps.get(s, Value) for s in inner):
            raise ValueError(f"nothing to measure: {p}")
    lacking = sorted({x for c in combos for x in (c.left, c.right)} - set(paths))
    if lacking:
        raise ValueError(f"operands that no line defines: {lacking}")
    return Features(tuple(measure(p, steps) for p in dict.fromkeys(paths)), tuple(dict.fromkeys(combos)), tuple(dict.fromkeys(order)), steps)
