"""What the operators share: table readers, the shared folder, small Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
#: Tasks over which the rows of one key are dealt where a key may hold a large part of all rows.
SALTS = 64

#: Characters with the Unicode property White_Space, which tokenizer patterns call \s.
WHITE = " \t\n\x0b\x0c\r\x85\xa0  -     　"


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all of them are one process, a local one stands in for it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, cut from its lineage, read again after a lost executor."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_dir(spark, what))
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "left") -> DataFrame:
    """rows.join(table, keys, how) for a table of one row a key, where one key may hold a large part of rows.

    Rows are dealt out by key and a salt from their column `by`; of the table each row goes to the salts that its key
    has, which is a join of at most SALTS rows a key.
    """
    own = salted(rows, by)
    places = own.select(*keys, "salt").distinct()
    return own.join(places.join(table, keys), [*keys, "salt"], how).drop("salt")


def outermost(rows: DataFrame, keys: list[str], value: str, f=F.min) -> DataFrame:
    """(the columns of rows, first) of the rows whose keys several rows have: first is the least value among those (or
    another aggregate). Copies of one row may be a large part of all: they are put together by key and salt first."""
    own = salted(rows, value)
    parts = own.groupBy(*keys, "salt").agg(f(value).alias("first"), F.count(F.lit(1)).alias("many"))
    whole = parts.groupBy(*keys).agg(f("first").alias("first"), F.sum("many").alias("many")).where("many > 1").drop("many")
    return own.join(parts.select(*keys, "salt").join(whole, keys), [*keys, "salt"]).drop("salt")


def mapped(df: DataFrame, f: Callable[..., Iterator[dict] | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with f from an iterator of column dicts to an iterator of column dicts, in the order of schema."""
    to = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for out in f(batches):
            if out is not None:
                cols = [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(out, to, strict=True)]
                yield pa.RecordBatch.from_arrays([c if c.type == t.type else c.cast(t.type) for c, t in zip(cols, to, strict=True)], schema=to)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def keep_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; a null text becomes an empty one. Further columns, whatever their names, go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def folder(path: str):
    """A pyarrow file system for a URI or a local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def put(path: str, name: str, data: bytes | Callable) -> None:
    """Write a file whole under its name: a second attempt at the same task replaces it by the same bytes."""
    file_system, at = folder(path)
    file_system.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex[:8]}"
    with file_system.open_output_stream(part, compression=None) as out:
        data(out) if callable(data) else out.write(data)
    file_system.move(part, f"{at}/{name}")


def range_cuts(df: DataFrame, column: str, parts: int) -> list[float]:
    """Cuts that split a numeric column into about equal ranges; only the column is read."""
    if parts < 2:
        return []
    own = df.select(F.col(column).cast("double").alias("x"))
    return sorted(set(own.approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)))


def by_range(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """df with a column part: the number of cuts at or below the value, 0 for null. Larger values never get a smaller part."""
    from pyspark.ml.feature import Bucketizer

    if not cuts:
        return df.withColumn("part", F.lit(0))
    splits = [-float("inf"), *cuts, float("inf")]
    keyed = df.withColumn("range_key", F.coalesce(F.col(column).cast("double"), F.lit(-1e300)))
    return Bucketizer(splits=splits, inputCol="range_key", outputCol="range_part").transform(keyed).withColumn("part", F.col("range_part").cast("int")).drop("range_key", "range_part")
