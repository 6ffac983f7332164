"""Trees by leaf against a grower in one process, and their models."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.operators import boosting, learning, reports


def made(seed, n, k=5):
    """Numbers of which some tell the label, some are missing, one never varies, one has few values."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    x[:, 1] = rng.integers(0, 4, n)
    x[:, 3] = 7
    score = 2 * (x[:, 0] > 0.3) * (x[:, 1] > 1) - 1.5 * (x[:, 2] < -0.5) + 0.3 * rng.normal(size=n)
    y = (score > 0.4).astype(int)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x, y


def frame(spark, x, y, parts=4):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), bool(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, f"x0 long, {', '.join(f'`in.{i}` double' for i in range(x.shape[1]))}, label boolean").repartition(parts)


def grown_by_hand(bins, y, score, allowed, s):
    """Leaf by leaf: the rows of each leaf, all splits tried, the largest gain taken."""
    g, h, _ = boosting.weighed(score, y, s.positive_weight)
    leaf = lambda rows: -s.rate * g[rows].sum() / (h[rows].sum() + s.l2)

    def best(rows):
        out = (0.0, 0, 0)
        for f in allowed:
            for cut in range(boosting.BINS - 1):
                left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if min(h[left].sum(), h[right].sum()) >= s.least_curvature:
                    gain = sum(g[r].sum() ** 2 / (h[r].sum() + s.l2) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
                    if gain > out[0] + 1e-9:
                        out = gain, f, cut
        return out

    leaves, values, paths = {"": np.arange(len(y))}, {}, {}
    while len(leaves) < s.leaves:
        open_ = {p: best(r) for p, r in leaves.items() if len(p) < s.depth}
        if not open_ or max(x[0] for x in open_.values()) <= 1e-9:
            break
        p = max(open_, key=lambda p: open_[p][0])
        _, f, cut = open_[p]
        rows = leaves.pop(p)
        paths[p] = f, cut
        leaves |= {p + "l": rows[bins[rows, f] <= cut], p + "r": rows[bins[rows, f] > cut]}
    values = {p: leaf(r) for p, r in leaves.items()}
    return paths, values


def as_paths(tree, node=0, path=""):
    if tree.feature[node] < 0:
        return {}, {path: tree.value[node]}
    splits, values = {path: (tree.feature[node], tree.bin[node])}, {}
    for side, n in (("l", tree.left[node]), ("r", tree.right[node])):
        a, b = as_paths(tree, n, path + side)
        splits |= a
        values |= b
    return splits, values


@pytest.mark.parametrize(("leaves", "depth", "share"), [(16, 8, 1.0), (7, 3, 0.6), (2, 1, 1.0)])
def test_trees_against_a_grower_by_hand(spark, monkeypatch, leaves, depth, share):
    monkeypatch.setattr(boosting, "BINS", 12)
    monkeypatch.setattr(boosting, "REWRITE", 2)
    x, y = made(3, 400)
    names = [f"in.{i}" for i in range(5)]
    s = boosting.Settings(trees=3, leaves=leaves, depth=depth, rate=0.3, feature_share=share)
    df = frame(spark, x, y)
    model = boosting.train(df, names, settings=s)
    bins = boosting.binned(list(x.T), boosting.cuts_of(df, names, 12))
    assert model.cuts == boosting.cuts_of(df, names, 12) and bins.max() < 12 and (bins[np.isnan(x)] == 0).all()
    rng, score = np.random.default_rng(s.seed), np.full(len(y), model.start)
    for tree in model.trees:
        allowed = sorted(rng.choice(5, max(1, round(share * 5)), replace=False).tolist())
        splits, values = grown_by_hand(bins, y, score, allowed, s)
        found, leaf_values = as_paths(tree)
        assert found == splits and leaf_values.keys() == values.keys() and all(leaf_values[p] == pytest.approx(values[p]) for p in values)
        score += np.array(tree.value)[tree.nodes(bins)]


def test_model_is_saved_and_as_good_as_trees_by_level(spark, tmp_path):
    names = [f"in.{i}" for i in range(5)]
    train, check, test = (frame(spark, *made(i, n)) for i, n in ((1, 900), (2, 300), (4, 500)))
    s = boosting.Settings(trees=12, rate=0.3, patience=3)
    model = boosting.train(train, names, validate=check, settings=s)
    assert len(model.trees) <= len(model.losses) <= 12 and model.losses[len(model.trees) - 1] == min(model.losses) and model.losses[0] > min(model.losses)
    boosting.save(model, spark, f"{tmp_path}/model")
    again = boosting.load(spark, f"{tmp_path}/model")
    assert again == model
    out = boosting.predict(again, test)
    assert out.columns == [*test.columns, "prob"] and out.count() == 500 and out.where("prob between 0 and 1").count() == 500
    auc = reports.auc(out, "label", "prob").first().auc
    plain = [c.replace(".", "_") for c in test.columns]
    level = learning.train_trees(train.toDF(*plain), [n.replace(".", "_") for n in names], rounds=12, depth=5, rate=0.3, feature_share="all")
    other = reports.auc(learning.predict(level, test.toDF(*plain), [n.replace(".", "_") for n in names]), "label", "prob").first().auc
    assert auc >= other - 0.01 and auc > 0.85, (auc, other)
    splits = dict(model.importance())
    assert min(splits["in.0"], splits["in.1"], splits["in.2"]) > 0


def test_odd_training_rows(spark):
    names = [f"in.{i}" for i in range(5)]
    x, y = made(1, 60)
    own = frame(spark, x, y)
    s = boosting.Settings(trees=2)
    for rows, low, high in ((own.where("label"), 0.9, 1), (own.where("not label"), 0, 0.1), (own.limit(0), 0.4, 0.6)):
        prob = [r.prob for r in boosting.predict(boosting.train(rows, names, settings=s), own).collect()]
        assert len(prob) == 60 and all(low <= p <= high for p in prob)
    without = own.unionByName(own.limit(9).withColumn("label", F.lit(None).cast("boolean")))
    assert boosting.train(without, names, settings=s) == boosting.train(own, names, settings=s)
    assert boosting.train(own, names, validate=own.limit(0), settings=dataclasses.replace(s, patience=1)).losses[0] is None
