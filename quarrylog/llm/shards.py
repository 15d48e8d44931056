"""Sharding (6): size-tiered compaction of immutable Parquet shards under versioned manifests.

``append`` writes arrivals as new small files and commits a manifest that lists them with all earlier ones. ``compact``
sorts the files below the target into tiers of similar size (powers of ``FAN_IN``); a tier with ``FAN_IN`` files
or more is merged into files near the target, tier by tier until nothing is left to merge. Merging needs no shuffle: the
scan itself packs a tier's files into partitions of the target size, and each task writes one file.

A manifest is written under a temporary name and renamed to its version without overwriting: where two writers
commit the same version one of them fails and starts again from the new state. Readers see one manifest, so all of
a version or nothing. Files are never changed, and ``vacuum`` deletes those that no kept manifest lists. The rename is
atomic on HDFS and local disks; object stores need a commit service. Manifests hold one entry a file, so
their size follows bytes / target.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarrylog.llm.common import by_value, free_name, shared_dir

TARGET_BYTES = 64 << 20
FAN_IN = 4
SMALLEST_BYTES = 64 << 10
ARRIVAL_ROWS = 2000
FULL = 0.6  # a file of this share of the target is left alone

by_value(__name__)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str | None = None, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.target, self.fan_in = spark, target_bytes, fan_in
        self.path = (path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}").rstrip("/")
        self._fs_classes = spark._jvm.org.apache.hadoop.fs
        self._fs = self._p().getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, *parts: str):
        return self._fs_classes.Path("/".join((self.path, *parts)))

    def _names(self, *parts: str) -> dict[str, int]:
        p = self._p(*parts)
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(p)} if self._fs.exists(p) else {}

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        return max((int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[0] != "_"), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "next": 0, "files": []}
        stream = self._fs.open(self._p("manifest", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, base: dict, files: list[dict], schema: str) -> int:
        """New files are numbered on in their order: the same arrivals give the same shard numbers."""
        numbered, number = [], base["next"]
        for f in files:
            if "shard" not in f:
                f, number = f | {"shard": number}, number + 1
            numbered.append(f)
        record = {"version": base["version"] + 1, "schema": schema, "next": number, "files": numbered}
        self._fs.mkdirs(self._p("manifest"))
        temporary, final = self._p("manifest", f"_{uuid.uuid4().hex}"), self._p("manifest", f"{record['version']:012d}.json")
        out = self._fs.create(temporary, False)
        out.write(json.dumps(record).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._fs_classes.Options.Rename, 0)
        try:
            self._fs_classes.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, final, options)
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise Conflict(f"version {record['version']} is taken") from e
            raise
        return record["version"]

    def _write(self, df: DataFrame, rows: int | None = None) -> list[dict]:
        """Writes new files and lists them; they count for nothing until a manifest names them."""
        run = uuid.uuid4().hex
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(f"{self.path}/data/{run}")
        return [{"file": f"{run}/{n}", "bytes": size} for n, size in sorted(self._names("data", run).items()) if n.endswith(".parquet")]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Adds arrivals as small shards; the first append fixes the schema. An empty table adds a version."""
        added = [f for f in self._write(df, rows)]
        while True:
            base = self.manifest()
            if base["schema"] not in (None, df.schema.json()):
                raise ValueError("the shards have another schema")
            try:
                return self._commit(base, base["files"] + added, df.schema.json())
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST_BYTES, self.fan_in)))

    def plan(self, files: list[dict]) -> list[list[dict]]:
        """Groups of similarly sized files worth merging."""
        tiers: dict[int, list[dict]] = {}
        for f in files:
            if f["bytes"] < FULL * self.target:
                tiers.setdefault(self.tier(f["bytes"]), []).append(f)
        return [t for _, t in sorted(tiers.items()) if len(t) >= self.fan_in]

    def _merge(self, group: list[dict], schema: T.StructType) -> list[dict]:
        """One scan partition, and so one file, per target size of input."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        return self._write(session.read.schema(schema).parquet(*[f"{self.path}/data/{f['file']}" for f in group]))

    def compact(self) -> int:
        """Merges tiers until none is worth it; returns the version then current. A writer that comes in between wins,
        and the plan is made anew; merged files that were not committed are left to vacuum."""
        stuck: set[frozenset] = set()
        while True:
            base = self.manifest()
            groups = [g for g in self.plan(base["files"]) if frozenset(f["file"] for f in g) not in stuck]
            if not groups:
                return base["version"]
            merged = self._merge(groups[0], T.StructType.fromJson(json.loads(base["schema"])))
            gone = {f["file"] for f in groups[0]}
            if len(merged) >= len(gone):  # nothing gained: the next tier's turn
                stuck.add(frozenset(gone))
                self._fs.delete(self._p("data", merged[0]["file"].partition("/")[0]), True)
                continue
            try:
                self._commit(base, [f for f in base["files"] if f["file"] not in gone] + merged, base["schema"])
            except Conflict:
                continue

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes files and manifests of all but the latest versions; returns the number of files deleted. Readers of
        older versions must be done, and no writer may be at work."""
        latest = self.version()
        kept = range(max(1, latest - keep_versions + 1), latest + 1)
        live = {f["file"] for v in kept for f in self.manifest(v)["files"]}
        deleted = 0
        for run in self._names("data"):
            names = self._names("data", run)
            dead = [n for n in names if n.endswith(".parquet") and f"{run}/{n}" not in live]
            deleted += len(dead)
            if len(dead) == sum(n.endswith(".parquet") for n in names):
                self._fs.delete(self._p("data", run), True)
            else:
                for n in dead:
                    self._fs.delete(self._p("data", run, n), False)
        for n in self._names("manifest"):
            if n[0] == "_" or int(n[:-5]) not in kept:
                self._fs.delete(self._p("manifest", n), False)
        return deleted

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """All rows of a version; with ``shard``, a name that no column has, also the number of each row's shard."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"])) if m["schema"] else T.StructType()
        if shard and shard.lower() in (n.lower() for n in schema.names):
            raise ValueError(f"the table has a column {shard}")
        if not m["files"]:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(shard, F.lit(0).cast("bigint")) if shard else empty
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f['file']}" for f in m["files"]])
        if not shard:
            return rows
        name = free_name(rows, "_file")
        numbers = self.spark.createDataFrame([(f["shard"], f["file"].rpartition("/")[2]) for f in m["files"]], T.StructType().add(shard, T.LongType()).add(name, T.StringType()))
        placed = rows.select("*", F.col("_metadata.file_name").alias(name))
        return placed.join(F.broadcast(numbers) if len(m["files"]) <= 100_000 else numbers, name).select(*[F.col(f"`{c}`") for c in rows.columns], shard)


def arrival_of(doc_id: Column, arrivals: int) -> Column:
    """The arrival (at most 16) of a row: by the first digit of the md5 of its id as text, NULL as the empty text."""
    return (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 1)) - 1) % arrivals


def build(docs: DataFrame, arrivals: int = 4, store: ShardStore | None = None) -> ShardStore:
    """A store to which the rows came in ``arrivals`` appends, by a hash of their ids, compacted after each."""
    store = store or ShardStore(docs.sparkSession)
    for k in range(arrivals):
        store.append(docs.where(arrival_of(F.col("doc_id"), arrivals) == k))
        store.compact()
        store.vacuum()
    return store


def report(docs: DataFrame, arrivals: int = 4) -> DataFrame:
    """doc_id, arrival, version (of the manifest read), settled (the row's shard is of the target size, or its tier has fewer shards than make a merge) and a
    digest of the text, read back from the compacted shards. Rows stay one for one, whatever the files or the
    partitions that the frame comes from; NULL ids are an arrival like others; an empty table gives no rows."""
    spark = docs.sparkSession
    store = build(docs.select("doc_id", "text"), arrivals)
    manifest = store.manifest()
    files = manifest["files"]
    waiting = {f["shard"] for group in store.plan(files) for f in group}
    known = spark.createDataFrame([(f["shard"], f["shard"] not in waiting) for f in files], "shard bigint, settled boolean")
    rows = store.read(manifest["version"], shard="shard").join(F.broadcast(known) if len(files) <= 100_000 else known, "shard")
    return rows.select("doc_id", arrival_of(F.col("doc_id"), arrivals).cast("bigint").alias("arrival"), F.lit(manifest["version"]).cast("bigint").alias("version"), "settled", F.sha2("text", 256).alias("text_sha256"))
