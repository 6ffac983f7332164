"""Training, scoring and choosing features with Spark ML."""

from __future__ import annotations

import random
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_bucket
from ..sources.files import write_headless_csv
from .reports import auc, mean_group_auc
from .shaping import filled_by_type

#: Weight of a positive row in training.
POSITIVE_WEIGHT = 4.0
SEED = 17


#: What tells a row to learn from apart, and is never an input.
IDS = ("user_id", "merchant_id", "coupon_id", "date", "discount_name", "label")


def hold_out(df: DataFrame, share: float = 0.05, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and to validate on, by a hash of keys (all columns if none), the same in every run."""
    mark = hash_bucket(10_000, *(keys or df.columns)) < int(share * 10_000)
    return df.where(~mark), df.where(mark)


@dataclass(frozen=True)
class Dataset:
    """Rows to learn from, to validate on and to foretell, with their ids and inputs; test rows may lack a label."""

    train: DataFrame
    validate: DataFrame
    test: DataFrame
    inputs: list[str]


def dataset(known: DataFrame, test: DataFrame, inputs: list[str] | None = None, share: float = 0.05) -> Dataset:
    """Known receipts dealt by user, coupon and day, and the columns of inputs (all that aren't ids if None)."""
    inputs = [c for c in known.columns if c not in IDS] if inputs is None else list(inputs)
    wanted = lambda df: df.select(*(c for c in df.columns if c in IDS and c not in inputs), *inputs)
    train, validate = hold_out(wanted(known), share, "user_id", "coupon_id", "date")
    return Dataset(train, validate, wanted(test), inputs)


def filled_inputs(df: DataFrame, inputs: list[str]) -> DataFrame:
    return filled_by_type(df, tuple(c for c in df.columns if c not in inputs))


def train_trees(df: DataFrame, inputs: list[str], label: str = "label", rounds: int = 20, depth: int = 5, rate: float = 0.1, feature_share: str = "0.2", validate: DataFrame | None = None, tolerance: float = 0.01) -> PipelineModel:
    """Gradient-boosted trees with weighted positives; missing inputs are 0.

    With rows to validate on, no round follows that lowers the loss on these by less than the tolerance.
    """
    rows = df.withColumn("validating", F.lit(False))
    if validate is not None:
        rows = rows.unionByName(validate.withColumn("validating", F.lit(True)))
    ready = filled_inputs(rows, inputs).withColumns({"target": F.col(label).cast("double"), "weight": F.when(F.col(label).cast("boolean"), POSITIVE_WEIGHT).otherwise(1.0)})
    trees = GBTClassifier(labelCol="target", weightCol="weight", featuresCol="inputs", maxIter=rounds, maxDepth=depth, stepSize=rate, featureSubsetStrategy=feature_share, seed=SEED, validationTol=tolerance)
    if validate is not None:
        trees.setValidationIndicatorCol("validating")
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="inputs", handleInvalid="keep"), trees]).fit(ready)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame, inputs: list[str]) -> DataFrame:
    """df with prob, the probability of the label."""
    return model.transform(filled_inputs(df, inputs)).withColumn("prob", vector_to_array("probability")[1]).drop("inputs", "rawPrediction", "probability", "prediction")


def submission(scored: DataFrame) -> DataFrame:
    """(user_id, coupon_id, date as yyyyMMdd[, label], prob)."""
    label = ["label"] if "label" in scored.columns else []
    return scored.select("user_id", "coupon_id", F.date_format("date", "yyyyMMdd").alias("date"), *label, "prob")


def save_and_score(scored: DataFrame, path: str) -> DataFrame | None:
    """Writes the submission without a head line; its scores, or None where the label isn't known."""
    write_headless_csv(submission(scored), path)
    return scores(scored) if "label" in scored.columns else None


def scores(df: DataFrame, label: str = "label", score: str = "prob", group: str = "coupon_id") -> DataFrame:
    """(mean_auc, n_groups, auc): over groups, and over all rows."""
    return mean_group_auc(df, label, score, group).crossJoin(auc(df, label, score))


def importance(model: PipelineModel, inputs: list[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(inputs, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def parameter_grid(**choices: list) -> list[dict]:
    """All combinations of the choices."""
    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def groups_by_substring(columns: list[str], parts: list[str]) -> dict[str, list[str]]:
    return {p: [c for c in columns if p in c] for p in parts}


def clusters(columns: list[str], n: int = 6, seed: int = SEED) -> list[list[str]]:
    """Columns dealt in turn, after a seeded shuffle."""
    own = sorted(columns)
    random.Random(seed).shuffle(own)
    return [own[i::n] for i in range(n)]


def by_deviation(df: DataFrame, column: str, sigma: float = 1.0) -> DataFrame:
    """df with level: high, low or middle, by mean and standard deviation of a score column."""
    ends = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("deviation"))
    own = df.crossJoin(F.broadcast(ends))
    high, low = F.col("mean") + F.lit(sigma) * F.col("deviation"), F.col("mean") - F.lit(sigma) * F.col("deviation")
    return own.withColumn("level", F.when(F.col(column) > high, "high").when(F.col(column) < low, "low").otherwise("middle")).drop("mean", "deviation")


@dataclass(frozen=True)
class Moments:
    """How many rows, the means of inputs, and the sums of products of their deviations from these."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray


def moments(df: DataFrame, inputs: list[str], by: str | None = None) -> dict:
    """Moments of each value of a column, of all rows under None if there is none; missing inputs are 0.

    A task adds up the products of its rows as matrices, and Spark adds up the tasks' matrices cell by cell, so the
    plan has no expression a pair of inputs. The driver gets one number a pair and value.
    """
    k = len(inputs)
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    near = [float(x or 0.0) for x in df.agg(*(F.avg(value(c)) for c in inputs)).first()]
    own = df.select(F.col(by).cast("string").alias("g") if by else F.lit(None).cast("string").alias("g"), *(value(c).alias(f"x{i}") for i, c in enumerate(inputs)))

    def run(batches):
        sums: dict = {}
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)]) - near
            groups = np.array(b.column(0).fill_null("").to_pylist())
            for g in set(groups.tolist()):
                at = x[groups == g]
                n, s, p = sums.get(g, (0, np.zeros(k), np.zeros((k, k))))
                sums[g] = n + len(at), s + at.sum(axis=0), p + at.T @ at
        # a row for each input: its sum, then its products; n with the first
        for g, (n, s, p) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * k), pa.array(range(k), pa.int32()), pa.array([[float(n), s[i], *p[i]] for i in range(k)])], names=["g", "i", "v"])

    cells = own.mapInArrow(run, "g string, i int, v array<double>").select("g", "i", F.posexplode("v").alias("j", "v")).groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
    found: dict = {}
    for r in cells.collect():
        found.setdefault(r.g, np.zeros((k, k + 2)))[r.i, r.j] = r.v
    out = {}
    for g, m in found.items():
        n, s = m[0, 0], m[:, 1]
        out[g if by else None] = Moments(int(n), np.array(near) + s / n, m[:, 2:] - np.outer(s, s) / n)
    return out


def projected(inputs: list[str], weights: np.ndarray, start: float = 0.0) -> Column:
    return sum((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) * F.lit(float(w)) for c, w in zip(inputs, weights, strict=True)), F.lit(float(start)))


def components(df: DataFrame, inputs: list[str], k: int = 2, whiten: bool = False, scale: bool = False) -> DataFrame:
    """df with pc_0 to pc_{k-1}: principal components, of scaled inputs or not, each divided by its deviation or not.

    The largest weight of a component, by size, is positive; missing inputs are 0, and an input that doesn't vary
    isn't scaled. One pass for the moments; the driver takes the eigenvectors of a matrix as large as the inputs.
    """
    all_ = moments(df, inputs).get(None)
    if all_ is None:
        return df.withColumns({f"pc_{i}": F.lit(None).cast("double") for i in range(k)})
    spread = all_.scatter / max(all_.n - 1, 1)
    unit = np.sqrt(np.where(np.diag(spread) > 0, np.diag(spread), 1.0)) if scale else np.ones(len(inputs))
    values, vectors = np.linalg.eigh(spread / np.outer(unit, unit))
    columns = {}
    for i, at in enumerate(np.argsort(-values, kind="stable")[:k]):
        w = vectors[:, at] * np.sign(vectors[np.argmax(np.abs(vectors[:, at])), at])
        w = w / unit / (np.sqrt(values[at]) if whiten and values[at] > 0 else 1.0)
        columns[f"pc_{i}"] = projected(inputs, w, -float(w @ all_.mean))
    return df.withColumns(columns)


def discriminant(df: DataFrame, inputs: list[str], label: str) -> tuple[np.ndarray, DataFrame]:
    """The direction, of length 1, that separates two classes best, and df with its projection ld, larger for the true
    class; ValueError if a class is missing. Missing inputs are 0."""
    by = moments(df, inputs, label)
    if "true" not in by or "false" not in by:
        raise ValueError("both classes are needed")
    within = by["true"].scatter + by["false"].scatter
    n = by["true"].n + by["false"].n
    w = np.linalg.solve(within / max(n - 2, 1) + 1e-12 * np.eye(len(inputs)), by["true"].mean - by["false"].mean)
    w /= np.linalg.norm(w) or 1.0
    return w, df.withColumn("ld", projected(inputs, w))
