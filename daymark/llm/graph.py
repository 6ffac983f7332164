"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted, spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the vertices of (u, v): the smallest id that each can reach.

    Each round takes the least label among a vertex's neighbours and then the label of that label, so long chains
    halve; aggregations combine before they shuffle, and nothing is gathered but a count. A vertex or a label that very
    many edges or vertices have is dealt out by a salt in the joins. Each round is a table in the shared folder; those
    that are spent are deleted.
    """
    own = edges.where("u != v").select("u", "v")
    both = written(salted(own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "u"), "edges")
    places = written(both.select("v", "salt").distinct(), "places")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "id"), "labels")
    while True:
        near = both.join(places.join(labels.withColumnRenamed("id", "v"), "v"), ["v", "salt"]).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        further = spread_join(step, jump, ["label"], "id")
        new = written(further.select("id", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        discard(labels)
        labels = new
        if not new.where("was != label").limit(1).count():
            discard(both, places)
            return new.select("id", F.col("label").alias("component"))
