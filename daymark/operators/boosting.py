"""Gradient-boosted trees that grow by leaf, from histograms.

Inputs are cut into bins once and stored, a byte an input. A tree always splits the leaf that gains most, until it has
its number of leaves; what a split gains is read off histograms of gradients by bin. Tasks make the histograms of their
rows with numpy, Spark deals these out by leaf and input, and each pair's best split is found where its histograms meet, so
the driver sees a row a leaf and input. One pass makes the histograms of what all present leaves could become, so a tree
takes fewer passes than it has leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import kept
from .partitions import by_key

#: Bins of an input; bin 0 is for missing values.
BINS = 255
#: Accuracy of the cuts between bins, as a share of the rows.
CUT_ERROR = 1 / 2048
#: Trees after which rows get their scores written anew, so that no pass applies more trees than that.
REWRITE = 10


@dataclass(frozen=True)
class Settings:
    """How trees grow: number, leaves and depth of trees, step, share of the inputs that each tree may use, weight of
    positive rows, what is added to a leaf's curvature, least curvature of a leaf, and how many trees that don't lower the
    loss of the validating rows end the training."""

    trees: int = 100
    leaves: int = 16
    depth: int = 8
    rate: float = 0.1
    feature_share: float = 1.0
    positive_weight: float = 4.0
    l2: float = 1.0
    least_curvature: float = 1e-3
    patience: int = 10
    seed: int = 17


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first: the input and the last bin of the left side, the two sides; -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        while (open_ := np.flatnonzero(feature[at] >= 0)).size:
            n = at[open_]
            at[open_] = np.where(bins[open_, feature[n]] <= cut[n], left[n], right[n])
        return at

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> Tree:
        """The tree with a leaf split in two."""
        n = len(self.feature)
        put = lambda own, x, more: [*own[:node], x, *own[node + 1 :], *more]
        return Tree(put(self.feature, feature, (-1, -1)), put(self.bin, cut, (0, 0)), put(self.left, n, (-1, -1)), put(self.right, n + 1, (-1, -1)), [*self.value, *values])


@dataclass(frozen=True)
class Model:
    """inputs, the cuts between their bins, the score before any tree, the trees, and the loss after each of them."""

    inputs: list[str]
    cuts: list[list[float]]
    start: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for t in self.trees:
            out += np.array(t.value)[t.nodes(bins)]
        return out

    def importance(self) -> list[tuple[str, int]]:
        """How many splits use each input, most first."""
        n = np.bincount([f for t in self.trees for f in t.feature if f >= 0], minlength=len(self.inputs))
        return sorted(zip(self.inputs, map(int, n), strict=True), key=lambda x: (-x[1], x[0]))


def numbers(df: DataFrame, inputs: list[str]) -> list:
    return [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(inputs)]


def cuts_of(df: DataFrame, inputs: list[str], bins: int | None = None) -> list[list[float]]:
    """Cuts between about equal bins of each input's known values: at most bins - 2, the driver's only look at values."""
    bins = bins or BINS
    own = df.select(*numbers(df, inputs))
    found = own.approxQuantile(own.columns, [i / (bins - 1) for i in range(1, bins - 1)], CUT_ERROR)
    return [sorted(set(x)) for x in found]


def binned(x: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    """A byte for each value: 0 where it is missing, else one more than the number of cuts below it."""
    return np.column_stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v, "left")).astype(np.uint8) for v, c in zip(x, cuts, strict=True)])


def values_of(batch: pa.RecordBatch, first: int, n: int) -> list[np.ndarray]:
    """n columns from a place on; missing values are NaN."""
    return [batch.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)]


def with_bins(df: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """(y, checks, score, bins) of (x0 ..., y, checks, score): rows that are ready to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = binned(values_of(b, 0, len(cuts)), cuts)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("checks"), b.column("score"), pa.array([r.tobytes() for r in bins], pa.binary())], names=["y", "checks", "score", "bins"])

    return df.mapInArrow(run, "y double, checks boolean, score double, bins binary")


def unpacked(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, n)


def weighed(score: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and loss of each row's score; positive rows count `weight` times."""
    w, p = np.where(y > 0, weight, 1.0), 1 / (1 + np.exp(-score))
    return w * (p - y), w * p * (1 - p), w * np.logaddexp(0, np.where(y > 0, -score, score))


def best_split(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, int, float, float]:
    """(gain, last bin of the left side, gradient and curvature there) of a histogram; gain 0 if no split is allowed."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + s.l2) + right_g**2 / (right_h + s.l2) - g.sum() ** 2 / (h.sum() + s.l2)
    gain = np.where((left_h >= s.least_curvature) & (right_h >= s.least_curvature), gain, 0.0)
    at = int(np.argmax(gain))
    return float(gain[at]), at, float(left_g[at]), float(left_h[at])


Split = tuple[float, int, int, float, float, float, float]  # gain, input, bin, gradient and curvature left, and in all


def best_splits(rows: DataFrame, trees: list[Tree], nodes: Tree, wanted: list[int], allowed: list[int], n_inputs: int, s: Settings) -> dict[int, Split]:
    """The best split of each wanted node of a tree, over rows whose scores lack the given trees.

    A task adds its rows up to a histogram for each node and input and hands on one row for each; histograms of one
    node and input meet, and only the best split leaves their task. An input's number decides between equal gains.
    """
    place = {n: i for i, n in enumerate(wanted)}
    width = len(wanted) * BINS

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_sums, h_sums = np.zeros((len(allowed), width)), np.zeros((len(allowed), width))
        for b in batches:
            learns = ~b.column("checks").to_numpy(zero_copy_only=False)
            bins = unpacked(b, n_inputs)[learns]
            y, score = (b.column(c).to_numpy()[learns] for c in ("y", "score"))
            score = score + sum((np.array(t.value)[t.nodes(bins)] for t in trees), np.zeros(len(bins)))
            g, h, _ = weighed(score, y, s.positive_weight)
            at = nodes.nodes(bins)
            own = np.isin(at, wanted)
            base = np.array([place.get(n, 0) for n in range(len(nodes.feature))])[at[own]] * BINS
            for k, f in enumerate(allowed):
                cell = base + bins[own, f]
                g_sums[k] += np.bincount(cell, g[own], width)
                h_sums[k] += np.bincount(cell, h[own], width)
        for i, n in enumerate(wanted):
            cells = slice(i * BINS, (i + 1) * BINS)
            packed = [np.concatenate([g_sums[k, cells], h_sums[k, cells]]).tobytes() for k in range(len(allowed))]
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(allowed), pa.int32()), pa.array(allowed, pa.int32()), pa.array(packed, pa.binary())], names=["node", "feature", "sums"])

    def meet(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(2 * BINS)
        for t in tables:
            for x in t.column("sums").to_pylist():
                whole += np.frombuffer(x)
        g, h = whole[:BINS], whole[BINS:]
        gain, cut, left_g, left_h = best_split(g, h, s)
        out = [key[0]], [key[1]], [gain], [cut], [left_g], [left_h], [float(g.sum())], [float(h.sum())]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if i in (0, 1, 3) else pa.float64()) for i, v in enumerate(out)], names=["node", "feature", "gain", "cut", "left_g", "left_h", "g", "h"])

    parts = rows.mapInArrow(histograms, "node int, feature int, sums binary")
    found = by_key(parts, ("node", "feature"), meet, "node int, feature int, gain double, cut int, left_g double, left_h double, g double, h double").collect()
    out: dict[int, Split] = {}
    for r in sorted(found, key=lambda r: (r.node, -r.gain, r.feature)):
        out.setdefault(r.node, (r.gain, r.feature, r.cut, r.left_g, r.left_h, r.g, r.h))
    return out


def grow(rows: DataFrame, trees: list[Tree], n_inputs: int, allowed: list[int], s: Settings) -> Tree:
    """The next tree: the leaf that gains most is split, again and again.

    full is the tree with every split that is known, tree the one that grows; splits of nodes that tree doesn't have
    yet are looked up there, and a pass is made only when the best leaf isn't known.
    """
    leaf = lambda g, h: -s.rate * g / (h + s.l2)
    full, known, depth = Tree(), {}, {0: 0}
    splits = best_splits(rows, trees, full, [0], allowed, n_inputs, s)
    known.update(splits)
    tree, of = replace(full, value=[leaf(*known[0][5:])]) if known else full, {0: 0}  # tree's node: full's node
    while known and sum(f < 0 for f in tree.feature) < s.leaves:
        leaves = [n for n, f in enumerate(tree.feature) if f < 0 and depth[of[n]] < s.depth]
        unknown = [n for n in leaves if of[n] not in known]
        if unknown:
            # a level below every leaf that may be split, as far as full goes
            for n, (gain, f, cut, *_) in list(known.items()):
                if gain > 0 and full.feature[n] < 0 and depth[n] < s.depth and n in {of[x] for x in leaves}:
                    depth.update({len(full.feature): depth[n] + 1, len(full.feature) + 1: depth[n] + 1})
                    full = full.split(n, f, cut, (0.0, 0.0))
            wanted = [n for n, f in enumerate(full.feature) if f < 0 and n not in known and depth[n] < s.depth]
            known.update(best_splits(rows, trees, full, wanted, allowed, n_inputs, s))
            known.update({n: (0.0, 0, 0, 0.0, 0.0, 0.0, 0.0) for n in wanted if n not in known})
        best = max(leaves, key=lambda n: (known[of[n]][0], -n), default=None)
        if best is None or known[of[best]][0] <= 1e-12:
            break
        _, f, cut, left_g, left_h, g, h = known[of[best]]
        node = of[best]
        if full.feature[node] < 0:
            depth.update({len(full.feature): depth[node] + 1, len(full.feature) + 1: depth[node] + 1})
            full = full.split(node, f, cut, (0.0, 0.0))
        of.update({len(tree.feature): full.left[node], len(tree.feature) + 1: full.right[node]})
        tree = tree.split(best, f, cut, (leaf(left_g, left_h), leaf(g - left_g, h - left_h)))
    return tree


def checked_loss(rows: DataFrame, trees: list[Tree], n_inputs: int, weight: float) -> float | None:
    """The mean loss of the validating rows, whose scores lack the given trees; None without such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = n = 0.0
        for b in batches:
            checks = b.column("checks").to_numpy(zero_copy_only=False)
            if checks.any():
                bins, y = unpacked(b, n_inputs)[checks], b.column("y").to_numpy()[checks]
                score = b.column("score").to_numpy()[checks] + sum((np.array(t.value)[t.nodes(bins)] for t in trees), np.zeros(len(bins)))
                total, n = total + weighed(score, y, weight)[2].sum(), n + np.where(y > 0, weight, 1.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], names=["total", "n"])

    r = rows.mapInArrow(run, "total double, n double").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    return r.total / r.n if r.n else None


def rescored(rows: DataFrame, trees: list[Tree], n_inputs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = unpacked(b, n_inputs)
            score = b.column("score").to_numpy() + sum((np.array(t.value)[t.nodes(bins)] for t in trees), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("checks"), pa.array(score), b.column("bins")], names=["y", "checks", "score", "bins"])

    return rows.mapInArrow(run, rows.schema)


def train(df: DataFrame, inputs: list[str], label: str = "label", validate: DataFrame | None = None, settings: Settings = Settings()) -> Model:  # noqa: B008
    """A model of a boolean or 0/1 label; rows without label don't count, missing inputs are below all others.

    With validating rows, the trees after the one with the least loss on them go.
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    known = lambda x, checks: x.where(F.col(label).isNotNull()).select(*numbers(x, inputs), F.col(label).cast("double").alias("y"), F.lit(checks).alias("checks"))
    own = known(df, False)
    total = own.agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") <= 0).alias("n")).first()
    start = float(np.clip(np.log(max(total.p * s.positive_weight, 1e-6) / max(total.n, 1e-6)), -10, 10)) if total.p + total.n else 0.0
    cuts = cuts_of(own, [f"x{i}" for i in range(len(inputs))])
    both = own if validate is None else own.unionByName(known(validate, True))
    rows = kept(with_bins(both.withColumn("score", F.lit(start)), cuts), "bins")
    trees, losses, waiting, best = [], [], [], 0
    for i in range(s.trees):
        allowed = sorted(rng.choice(len(inputs), max(1, round(s.feature_share * len(inputs))), replace=False).tolist())
        tree = grow(rows, waiting, len(inputs), allowed, s)
        trees.append(tree)
        waiting.append(tree)
        if validate is not None:
            losses.append(checked_loss(rows, waiting, len(inputs), s.positive_weight))
            best = min(range(len(losses)), key=lambda j: (losses[j], j)) if losses[-1] is not None else i
            if i - best >= s.patience:
                break
        if len(waiting) == REWRITE and i + 1 < s.trees:
            rows, waiting = kept(rescored(rows, waiting, len(inputs)), "bins"), []
    return Model(list(inputs), cuts, start, trees[: best + 1] if validate is not None else trees, losses)


def predict(model: Model, df: DataFrame) -> DataFrame:
    """df with prob, the probability of the label, in place of a column of that name."""
    df = df.drop("prob")
    width, n, schema = len(df.columns), len(model.inputs), df.withColumn("prob", F.lit(0.0)).schema
    plain = df.toDF(*(f"c{i}" for i in range(width)))
    inputs = [F.col(f"c{df.columns.index(c)}").cast("double").alias(f"x{i}") for i, c in enumerate(model.inputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prob = 1 / (1 + np.exp(-model.scores(binned(values_of(b, width, n), model.cuts))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), pa.array(prob)], names=schema.names)

    return plain.select("*", *inputs).mapInArrow(run, schema)


def save(model: Model, spark: SparkSession, path: str) -> None:
    """A model as lines of JSON: what it starts from, then a tree a line."""
    head = {"inputs": model.inputs, "cuts": model.cuts, "start": model.start, "losses": model.losses}
    lines = [(0, json.dumps(head)), *((i + 1, json.dumps(asdict(t))) for i, t in enumerate(model.trees))]
    spark.createDataFrame(lines, "line int, said string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    head, *trees = [json.loads(r.said) for r in spark.read.parquet(path).orderBy("line").collect()]
    return Model(head["inputs"], head["cuts"], head["start"], [Tree(**t) for t in trees], head["losses"])
