"""A bounded, stratified sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_text


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a missing id is held out as well."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % modulus == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of at most `most` labelled rows outside the held-out fold, and each class's weight.

    Half of the rows come from each class, or all of a class that has fewer, in the order of a hash of doc_id; the
    weight of a class is its share in all labelled rows over its share in the sample. Rows without a label of 0 or 1
    don't count; of several labels of one document the larger counts. Only the sampled ids are held by the driver.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.where(~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    small = min(total.values(), default=0)
    share = {y: most // 2 if small >= most // 2 else most - small if n > small else small for y, n in total.items()}
    ids = [(r.doc_id, r.label) for y in total for r in own.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share[y]).collect()]
    taken = {y: sum(z == y for _, z in ids) for y in total}
    weights = {y: (total[y] / sum(total.values())) / (taken[y] / max(len(ids), 1)) for y in total if taken[y]}
    few = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    # at most `most` rows of two numbers
    return keep_text(docs).join(F.broadcast(few), "doc_id"), weights
