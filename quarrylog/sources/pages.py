"""Fixed-size page files as tables.

Spark has no in-place page write; a page file becomes an immutable table of pages, and an update is a
newer version of a row (``operators.versions``). The raw 4096-byte layout can be read and written.
"""

from __future__ import annotations

import json
import uuid
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylog.schema import PAGE_BYTES, PAGE_HEADER_BYTES


def page_of(key: Column, keys_per_page: int = 100) -> Column:
    return F.floor(key / F.lit(keys_per_page)).cast("bigint")


def with_page(df: DataFrame, key: str, keys_per_page: int = 100) -> DataFrame:
    """Adds page_id and its byte offset in a page file."""
    page = page_of(F.col(key), keys_per_page)
    return df.withColumn("page_id", page).withColumn("byte_offset", page * PAGE_BYTES)


def _le(raw: Column, at: int, n: int) -> Column:
    """Unsigned little-endian integer of n bytes at a 0-based offset."""
    return F.conv(F.hex(_reverse_bytes(raw, at, n)), 16, 10).cast("bigint")


def _reverse_bytes(raw: Column, at: int, n: int) -> Column:
    return F.concat(*[F.substring(raw, at + k, 1) for k in range(n, 0, -1)])


def _signed(value: Column) -> Column:
    return F.when(value >= 2**31, value - 2**32).otherwise(value).cast("int")


def read_page_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pages of raw page files: header fields and payload. A short last page is zero-filled; a page past
    the end has no row (``page_or_zero`` gives zeros for it). One file is one task: page files are small
    by construction (a file over 2 GB does not fit ``binaryFile``; split it first)."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    n = F.ceil(F.col("length") / F.lit(PAGE_BYTES)).cast("bigint")
    pages = raw.where(F.col("length") > 0).select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("slot"), "content").select(
        "path", "slot", F.rpad(F.expr(f"substring(content, cast(slot * {PAGE_BYTES} + 1 as int), {PAGE_BYTES})"), PAGE_BYTES, F.unhex(F.lit("00"))).alias("raw")
    )
    r = F.col("raw")
    return pages.select(
        "path",
        "slot",
        _signed(_le(r, 0, 4)).alias("page_id"),
        _signed(_le(r, 4, 4)).alias("creation_version"),
        _le(r, 8, 4).alias("key_count"),
        (_le(r, 12, 1) != 0).alias("is_leaf"),
        F.substring(r, PAGE_HEADER_BYTES + 1, PAGE_BYTES).alias("payload"),
    )


def _bytes_le(value: Column, n: int) -> Column:
    raw = F.unhex(F.lpad(F.hex(value.bitwiseAND(F.lit((1 << 8 * n) - 1))), 2 * n, "0"))
    return F.concat(*[F.substring(raw, k, 1) for k in range(n, 0, -1)])


def raw_page() -> Column:
    """The 4096 bytes of a row (page_id, creation_version, key_count, is_leaf, payload): the payload is cut or zero-filled;
    a NULL id or version is -1, any other NULL zero."""
    zero = F.unhex(F.lit("00"))
    payload = F.rpad(F.coalesce(F.substring("payload", 1, PAGE_BYTES - PAGE_HEADER_BYTES), F.lit(b"")), PAGE_BYTES - PAGE_HEADER_BYTES, zero)
    number = lambda c, missing: F.coalesce(F.col(c).cast("bigint"), F.lit(missing).cast("bigint"))
    leaf = F.when(F.col("is_leaf"), F.unhex(F.lit("01"))).otherwise(zero)
    return F.concat(_bytes_le(number("page_id", -1), 4), _bytes_le(number("creation_version", -1), 4), _bytes_le(number("key_count", 0), 4), leaf, F.unhex(F.lit("000000")), payload)


def write_page_files(pages: DataFrame, path: str, files: int | None = None) -> int:
    """Writes pages in the raw layout (S9), ranges of page_id side by side, one file a range; returns the number of pages
    written (S11). Every task writes a file of its own name through pyarrow's file systems; a manifest, written
    last, lists those of the tasks that count, so files of failed or doubled attempts are never read."""
    rows = pages.select("page_id", raw_page().alias("raw"))
    rows = (rows.repartitionByRange(files, "page_id") if files else rows.repartitionByRange("page_id")).sortWithinPartitions("page_id")
    hadoop = pages.sparkSession._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    disk = place.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration())
    disk.mkdirs(place)
    target = disk.makeQualified(place).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(target)
        name, n, first, out = f"{uuid.uuid4().hex}.pages", 0, None, None
        for batch in batches:
            if len(batch):
                if out is None:
                    first, out = batch.column("page_id")[0].as_py(), system.open_output_stream(f"{folder}/{name}")
                out.write(b"".join(batch.column("raw").to_pylist()))
                n += len(batch)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "n": n, "first": first}], pa.schema([("name", pa.string()), ("n", pa.int64()), ("first", pa.int64())]))

    done = sorted(rows.mapInArrow(run, "name string, n bigint, first bigint").collect(), key=lambda r: (r.first is not None, r.first))  # one row a file
    stream = disk.create(hadoop.Path(f"{path}/manifest.json"), True)
    stream.write(json.dumps([r.name for r in done]).encode())
    stream.close()
    return sum(r.n for r in done)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """read_page_file() of what write_page_files() wrote; no files, no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{path}/manifest.json")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    names = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    if not names:
        return spark.createDataFrame([], "path string, slot bigint, page_id int, creation_version int, key_count bigint, is_leaf boolean, payload binary")
    return read_page_file(spark, [f"{path}/{n}" for n in names])


def page_or_zero(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reads by id: ``wanted(page_id)`` left-joined; a page that is not there reads as zeros."""
    zero = F.unhex(F.lit("00" * (PAGE_BYTES - PAGE_HEADER_BYTES)))
    have = pages.select("page_id", "payload")
    return wanted.select("page_id").join(have, "page_id", "left").withColumn("payload", F.coalesce("payload", zero))


def allocate_ids(rows: DataFrame, existing_max: int, order: str) -> DataFrame:
    """Gives new rows the ids after ``existing_max`` (never reissued, unlike a counter that restarts).
    ``order`` must be unique; ids are dense: a prefix sum over blocks of 65,536 keys, no global sort."""
    from quarrylog.operators.keyindex import dense_rank_of

    return dense_rank_of(rows, order, "page_id").withColumn("page_id", F.col("page_id") + F.lit(existing_max + 1))
