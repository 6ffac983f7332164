"""CSV and Parquet in and out, and tables that a session derives."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import DISCOUNTS, EVENTS, RAW_OFFLINE, RAW_ONLINE, RAW_TEST


def read_typed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file with a head line, typed, in which the word null is missing, and an empty field unless it is quoted.

    A bad row fails the read, and so does a head line with other names than the schema's.
    """
    return spark.read.csv(path, schema=schema, header=True, nullValue="null", emptyValue="", mode="FAILFAST", enforceSchema=False)


def write_typed_csv(df: DataFrame, path: str) -> None:
    """What read_typed_csv reads: a head line in each file, and the word null for what is missing.

    A text that is the word null itself would come back as missing, so it fails the write.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    for c in texts:
        df = df.withColumn(c, F.when(F.col(c) == "null", F.raise_error(F.lit(f"{c}: the text null stands for a missing value"))).otherwise(F.col(c)))
    df.write.mode("overwrite").csv(path, header=True, nullValue="null", emptyValue='""')


def read_offline(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path, RAW_OFFLINE)


def read_online(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path, RAW_ONLINE)


def read_test(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path, RAW_TEST)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path, EVENTS)


def read_discounts(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path, DISCOUNTS)


def read_headless_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV file without a head line; columns is a DDL string."""
    return spark.read.csv(path, schema=columns, header=False)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_headless_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=False)


def write_json(value, path: str) -> None:
    """A small driver-side value, such as lists of column names."""
    with open(path, "w") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)


def read_json(path: str):
    with open(path) as f:
        return json.load(f)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one stands in only where all of them are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, for the few calls that Spark has none for."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def state_of(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> tuple:
    """Names, sizes and times of change of the files of a folder's tables."""
    out = []
    for t in tables:
        system, path = _place(spark, f"{folder}/{t}.parquet")
        files = system.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def session_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that goes with the session."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    system, own = _place(spark, path)
    system.mkdirs(own)
    system.deleteOnExit(own)
    return path


def removed(spark: SparkSession, path: str) -> None:
    system, own = _place(spark, path)
    system.delete(own, True)


#: Bytes of input files for each bucket, and for each part of a shuffle whose rows are wide.
BUCKET_BYTES = 8 << 20
PART_BYTES = 4 << 20
#: How many buckets' share of the rows one key may have.
MOST_BUCKETS = 2
#: By session, folder and name: the state of the inputs, and where the files are.
_STORED: dict[tuple, tuple[tuple, str]] = {}


def stored_at(spark: SparkSession, folder: str, name: str, write: Callable[[str], object], inputs: tuple[str, ...] = ()) -> str:
    """Where files derived from a folder's tables are: `write` puts them into the shared folder on first use.

    They are written again where files of the inputs have changed or they are gone, and go with the session.
    """
    key, state = (spark.sparkContext.applicationId, folder, name), state_of(spark, folder, inputs)
    if key in _STORED:
        old, path = _STORED[key]
        system, own = _place(spark, path)
        if old == state and system.exists(own):
            return path
        removed(spark, path)
    path = session_folder(spark, name)
    write(path)
    _STORED[key] = state, path
    return path


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], inputs: tuple[str, ...] = ()) -> DataFrame:
    """A table derived from a folder's tables: computed once as long as the inputs stay, and read from the shared folder."""
    return spark.read.parquet(stored_at(spark, folder, name, lambda path: build().write.mode("overwrite").parquet(path), inputs))


def parts_of(spark: SparkSession, folder: str, inputs: tuple[str, ...], size: int | None = None) -> int:
    """In how many parts the work on inputs is done: one for each PART_BYTES (or size) of their files, so that a part
    doesn't grow with them, but no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-sum(n for _, n, _ in state_of(spark, folder, inputs)) // (size or PART_BYTES)))


def dealt_at_least(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """df in a number of parts by columns, and with it what is joined to it by these; as it is without a number, or where
    Spark's own number is as large, as Spark then puts small ones together up to a size that doesn't grow either."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *by) if parts and parts > own else df


def stored_by(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], inputs: tuple[str, ...], key: str, order: str) -> DataFrame:
    """The same, dealt into buckets by a key, each in the order of key and order: about one for each BUCKET_BYTES of the
    inputs, but no fewer than there are cores.

    What groups, joins or looks around by the key, or by it and more, then reads a bucket a task and shuffles nothing.
    A bucket is one task's: where one key has more than MOST_BUCKETS buckets' share of the rows, the table stays as it is.
    """
    n = parts_of(spark, folder, inputs, BUCKET_BYTES)

    def write(path: str) -> None:
        df = build()
        rows, most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
        if rows and most > MOST_BUCKETS * rows / n:
            df.write.mode("overwrite").parquet(path)
            return
        df.repartition(n, key).write.mode("overwrite").option("path", path).bucketBy(n, key).sortBy(key, order).saveAsTable(_table(path))

    path = stored_at(spark, folder, f"{name}_by_{key}", write, inputs)
    return spark.table(_table(path)) if spark.catalog.tableExists(_table(path)) else spark.read.parquet(path)


def _table(path: str) -> str:
    return "daymark_" + "".join(c if c.isalnum() else "_" for c in path.rpartition("/")[2])


def in_buckets(spark: SparkSession, folder: str, name: str, key: str) -> bool:
    """Whether a table that stored_by has derived is in buckets."""
    found = _STORED.get((spark.sparkContext.applicationId, folder, f"{name}_by_{key}"))
    return found is not None and spark.catalog.tableExists(_table(found[1]))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, the same at each read, read again after a lost executor."""
    path = session_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_views(**frames: DataFrame) -> None:
    """Make frames visible to SQL under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
