"""Shared helpers: the shared work folder, written intermediate tables, stable hashes, process caches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from typing import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def by_value(name: str) -> None:
    """Functions of this module travel to the workers by value: no install or path is needed there."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)

SALTS = 16
RUN_BYTES = 1 << 21
BATCH_BYTES = 1 << 23
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset, the context's checkpoint
    folder. Without either, a local session (tests) gets a new temporary folder; a cluster has no shared place, an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrylog"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """One folder of the shared one for all tables of this application, deleted when its driver ends."""
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(place):
        files.deleteOnExit(place)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut, lost executors cost
    nothing that is finished, and no task repeats it."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))  # what a Python worker and the JVM beside it hold at once
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before) if before else spark.conf.unset(BATCH_SETTING)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing will read it again."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; NULL ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def draw(rows: DataFrame, by: str, most: int, chars: int) -> DataFrame:
    """At most ``most`` rows(doc_id, _n, by) of each value of ``by``: texts of up to ``chars`` characters first, by a hash of
    the id, then longer ones, the shortest first, while all together have no more than most * chars characters."""
    order = [F.greatest("_n", F.lit(chars)), F.xxhash64("doc_id"), F.col("doc_id"), F.col("_n")]
    # ranked within salts first: one value may have all rows
    salt = F.pmod(F.xxhash64("_n", "doc_id"), F.lit(SALTS))
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(by, salt).orderBy(*order))).where(F.col("_r") <= most)
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_r") <= most)
    return ranked.withColumn("_sum", F.sum("_n").over(W.partitionBy(by).orderBy("_r"))).where(F.col("_sum") <= most * chars).drop("_r", "_sum")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs whose texts have at most ``most`` bytes together (or are one text), so that a worker turns
    no more than that into Python objects at once."""
    start = rows = size = 0
    for n in pc.binary_length(texts).to_pylist():
        if rows and size + (n or 0) > most:
            yield start, rows
            start, rows, size = start + rows, 0, 0
        rows, size = rows + 1, size + (n or 0)
    if rows:
        yield start, rows


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, whatever task runs in it."""
    return sys.__dict__.setdefault("_quarrylog_cache", {})


def cached(key: tuple, make):
    """What ``make`` gave for the key before in this worker; key[0] names the operator."""
    cache = process_cache()
    if key not in cache:
        alone(key[0])
        cache[key] = make()
    return cache[key]


def alone(operator: str) -> None:
    """Called where an operator's task begins: workers are used again, and what other operators left in one goes."""
    cache = process_cache()
    if left := [k for k in cache if k[0] != operator]:
        for k in left:
            del cache[k]
        gc.collect()
        ctypes.CDLL(None).malloc_trim(0)
