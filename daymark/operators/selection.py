"""Choosing features by what each adds to the scores of a model.

What is to be trained is a plan: a list of models by name, each with its inputs. A plan runs several trainings at once over
one stored data set and appends its scores to a table; names that the table has aren't trained again, so a plan that was
cut off goes on. Which features are good or bad follows from such tables, as a query.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import kept, write_json
from .learning import Dataset, predict, scores, train_trees

SETS = ("test", "validate", "train")
SCORES = tuple(f"{s}_{kind}" for s in SETS for kind in ("group_auc", "auc"))
COLUMNS = f"cluster string, feature string, {', '.join(f'{c} double' for c in SCORES)}"


@dataclass(frozen=True)
class Trial:
    """A model to train: what it stands for, and its inputs."""

    cluster: str
    feature: str
    inputs: tuple[str, ...]


def without_each(clusters: dict[str, list[str]]) -> list[Trial]:
    """Of each cluster, models of its features without one of them."""
    return [Trial(c, f, tuple(x for x in features if x != f)) for c, features in clusters.items() for f in features]


def with_each(cluster: str, fixed: Iterable[str], others: Iterable[str]) -> list[Trial]:
    """Models of fixed features with one of the others."""
    fixed = tuple(fixed)
    return [Trial(cluster, f, (*fixed, f)) for f in others if f not in fixed]


def score_inputs(data: Dataset, inputs: Iterable[str], **settings) -> dict[str, float | None]:
    """Mean AUC over coupons and AUC over all rows of each set, of a model of some inputs; None without a label."""
    inputs = list(inputs)
    model = train_trees(data.train, inputs, validate=data.validate, **settings)
    out = {}
    for name, rows in zip(SETS, (data.test, data.validate, data.train), strict=True):
        got = scores(predict(model, rows, inputs)).first() if "label" in rows.columns else None
        out |= {f"{name}_group_auc": got and got.mean_auc, f"{name}_auc": got and got.auc}
    return out


def stored_data(data: Dataset) -> Dataset:
    """The data set as tables in the shared folder, which all trainings read."""
    return Dataset(kept(data.train, "train"), kept(data.validate, "validate"), kept(data.test, "test"), data.inputs)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, feature, six scores) of a score table; none yet is an empty one."""
    spark.createDataFrame([], COLUMNS).write.mode("append").parquet(path)
    return spark.read.schema(COLUMNS).parquet(path)


def run_plan(data: Dataset, plan: list[Trial], path: str, pool: int = 4, batch: int = 16, **settings) -> DataFrame:
    """Trains what the score table at path lacks, `pool` models at once, and appends the scores of each batch in one
    write. A batch that fails is lost, those before it stay. data should be stored_data."""
    spark = data.train.sparkSession
    done = {(r.cluster, r.feature) for r in read_scores(spark, path).select("cluster", "feature").collect()}
    left = [t for t in dict.fromkeys(plan) if (t.cluster, t.feature) not in done]

    def one(trial: Trial) -> tuple:
        got = score_inputs(data, trial.inputs, **settings)
        return trial.cluster, trial.feature, *(got[c] for c in SCORES)

    with ThreadPoolExecutor(pool) as workers:
        for i in range(0, len(left), batch):
            rows = list(workers.map(inheritable_thread_target(one), left[i : i + batch]))
            spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(COLUMNS).parquet(path)


def long_scores(scored: DataFrame) -> DataFrame:
    """(cluster, feature, score, value): a row for each score of a feature."""
    each = F.array(*(F.struct(F.lit(c).alias("score"), F.col(c).alias("value")) for c in SCORES))
    return scored.select("cluster", "feature", F.explode(each).alias("x")).select("cluster", "feature", "x.*")


def beyond(scored: DataFrame, level: str, by: tuple[str, ...], sigma: Column) -> DataFrame:
    """Rows of long_scores whose value is more than sigma deviations below (low) or above (high) the mean of its group."""
    long = long_scores(scored)
    ends = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    edge = F.col("mean") + sigma * F.col("deviation") * (-1 if level == "low" else 1)
    return long.join(ends, list(by)).where(F.col("value") < edge if level == "low" else F.col("value") > edge)


def cluster_choice(scored: DataFrame) -> DataFrame:
    """(feature): those without which any score of their cluster falls low."""
    return beyond(scored, "low", ("cluster", "score"), F.lit(1.0)).select("feature").distinct()


def levels(scored: DataFrame, level: str, features: DataFrame) -> DataFrame:
    """(feature, level): good beyond the mean of the test set's mean AUC, bad as an outlier by another score alone,
    other for the rest of the features."""
    first = F.col("score") == SCORES[0]
    marks = beyond(scored, level, ("score",), F.when(first, 0.0).otherwise(1.0)).groupBy("feature").agg(F.bool_or(first).alias("good"))
    all_ = features.select("feature").distinct().join(marks, "feature", "full_outer")
    return all_.select("feature", F.when(F.col("good"), "good").when(~F.col("good"), "bad").otherwise("other").alias("level"))


def feature_levels(without: DataFrame, added: DataFrame, chosen: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, level) by what the chosen score without each and with each of the others.

    The two verdicts are united, so a feature may stand on more than one level.
    """
    return levels(without, "low", chosen).unionByName(levels(added, "high", features)).distinct()


def save_levels(found: DataFrame, path: str) -> dict[str, list[str]]:
    """Features by level, sorted, as a JSON file of the driver: a few names."""
    out = {k: sorted(r.feature for r in found.where(F.col("level") == k).collect()) for k in ("good", "bad", "other")}
    write_json(out, path)
    return out


def select_features(data: Dataset, clusters: dict[str, list[str]], path: str, pool: int = 4, **settings) -> DataFrame:
    """(feature, level) from data alone: each cluster without each of its features, then the chosen features without
    each, then with each of the others. Score tables stand under path, and a second run goes on from them."""
    spark, data = data.train.sparkSession, stored_data(data)
    features = sorted({f for own in clusters.values() for f in own})
    chosen = sorted(r.feature for r in cluster_choice(run_plan(data, without_each(clusters), f"{path}/clusters", pool, **settings)).collect())
    without = run_plan(data, without_each({"base": chosen}) if len(chosen) > 1 else [], f"{path}/base", pool, **settings)
    added = run_plan(data, with_each("other", chosen, features), f"{path}/other", pool, **settings)
    names = lambda own: spark.createDataFrame([(f,) for f in own], "feature string")
    return feature_levels(without, added, names(chosen), names(features))
