"""Comma-separated log records: read, parse, format, write, synthesise.

Format: ``epoch_ms,resource_id,resource_name,event_type``, one record a line, no header, no quotes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylog.functions.text import clip_bytes, lenient_bigint
from quarrylog.schema import EVENT_BYTES, LOG_SCHEMA, NAME_BYTES

EVENTS = ("START", "STOP", "RESTART", "ERROR", "WARNING", "DEPLOY")
MAX_MS = 253402300799999


def _field(parts: Column, i: int, last_empty_is_null: bool = True) -> Column:
    value = F.get(parts, F.lit(i))
    if not last_empty_is_null:
        return value
    final = (F.size(parts) == i + 1) & (value == "")
    return F.when(~final, value)


def parse_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = (), default_ms: Column | None = None) -> DataFrame:
    """Typed records of raw lines; zero-length lines go. A bad time gives NULL and ``ts_bad`` (or
    ``default_ms`` where given), a bad id 0, missing fields NULL. Fields past the fourth are ignored. Names are cut to 63
    bytes and event types to 15, never inside a character. Lines are split once, then read field by field."""
    split = lines.where(F.length(column) > 0).select(*keep, F.split(F.col(column), ",", -1).alias("_parts"))
    parts, ms = F.col("_parts"), F.col("_ms")
    read = split.select(*keep, "_parts", lenient_bigint(F.get(parts, F.lit(0))).alias("_ms"), _field(parts, 1).alias("_id"))
    read = read.withColumn("_ms", F.when(ms.between(-MAX_MS, MAX_MS), ms))
    id_text = F.col("_id")
    return read.select(
        *keep,
        (ms if default_ms is None else F.coalesce(ms, default_ms)).alias("epoch_ms"),
        F.when(id_text.isNotNull(), F.coalesce(lenient_bigint(id_text), F.lit(0).cast("bigint"))).alias("resource_id"),
        clip_bytes(_field(parts, 2), NAME_BYTES).alias("resource_name"),
        clip_bytes(_field(parts, 3), EVENT_BYTES).alias("event_type"),
        ms.isNull().alias("ts_bad"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records of a text file or folder; a path that does not exist gives no rows."""
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG_SCHEMA)
    return parse_lines(lines)


def log_line(ms: str = "epoch_ms", rid: str = "resource_id", name: str = "resource_name", event: str = "event_type") -> Column:
    """One CSV line; NULL text fields become empty, a NULL time or id an empty token."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (ms, rid, name, event)])


def write_logs(df: DataFrame, path: str, order: str | None = None, files: int | None = None) -> None:
    """Lines in ``order`` as a folder of text files (range-partitioned, so the parts' names keep the order);
    ``files=1`` gives one file, for small exports only."""
    if order:
        df = df.repartitionByRange(files, order).sortWithinPartitions(order) if files else df.orderBy(order)
    df.select(log_line().alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def synthetic_logs(spark: SparkSession, count: int, base_ms: int, start_resource_id: int = 1000, step_ms: int = 100) -> DataFrame:
    """The deterministic generator: 50 resources, 6 event types, ``step_ms`` apart from ``base_ms``.
    64-bit arithmetic throughout, partitioned by ``range``."""
    i = F.col("id")
    return spark.range(count).select(
        i.alias("seq"),
        (F.lit(base_ms) + i * step_ms).alias("epoch_ms"),
        (F.lit(start_resource_id) + i % 50).cast("bigint").alias("resource_id"),
        F.concat(F.lit("vm-node-"), (i % 50).cast("string")).alias("resource_name"),
        F.element_at(F.array(*map(F.lit, EVENTS)), (i % len(EVENTS) + 1).cast("int")).alias("event_type"),
    )
