"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch between the JVM and Python, where the session has Spark's default: texts can be long.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data set."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and driver and executors are one process (tests) a local folder is used and set;
    elsewhere that is an error, as executors would write to disks that nobody else reads.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomcrawl-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark then deletes the shuffle files of a query at its end, not when the driver's next garbage collection finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(spark: SparkSession, df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """df written to the shared folder and read again: the lineage ends there, and a lost executor costs a re-read.

    The shuffle files of the write go with its end.
    """
    path, before = scratch(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", 16 << 20).option("compression", compression).parquet(path)  # what a writing task buffers
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that become Python objects at once; long texts make Arrow's own batches large.
SLICE = 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, schema, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = SLICE) -> DataFrame:
    """mapInArrow with per-task state: make() runs once in each task and returns the function for one slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in slices(batches, rows):
            yield step(batch)

    return df.mapInArrow(run, schema)


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers of which repartition(n, key) sends one to each partition (Spark's hash partitioning, asked of Spark)."""
    found: dict[int, int] = {}
    span = 8 * n + 64
    while len(found) < n:
        rows = spark.range(span).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
        found = {r.p: r.id for r in rows}
        span *= 4
    return [found[i] for i in range(n)]


_KEPT: dict[str, tuple[object, object]] = {}


def kept(kind: str, key, make: Callable[[], object]):
    """What make() returns, once in each Python worker and key: Spark gives a worker many tasks.

    Only the last kind is kept, so operators that follow each other don't add up their memory.
    """
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT.clear()
        _KEPT[kind] = (key, make())
    return _KEPT[kind][1]


class Recent(dict):
    """value(key) of keys, remembered for the last `size` to twice as many distinct ones. Bounds memory, never results."""

    def __init__(self, size: int, value: Callable):
        self.size, self.value, self.old = size, value, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.value(key)
        self.room()
        self[key] = found
        return found

    def room(self) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of what df reads; where it has none (no files below), the bytes of df's text column."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]
