"""Versioned key/value data: as-of reads, commit visibility, lineage, and a store.

``VersionStore`` keeps each version's changes as immutable Parquet and makes it visible by one rename of a
manifest file. That rename is atomic on HDFS and local disks; object stores need a commit service.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


def as_of(log: DataFrame, key: str, value: str, seq: str, version: str, at: int) -> DataFrame:
    """Latest value per key among versions <= at."""
    return log.where(F.col(version) <= at).groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias("last_seq"))


def committed(log: DataFrame, versions: DataFrame, version: str) -> DataFrame:
    """Rows of committed versions: a semi join with the (small) version table."""
    return log.join(versions.where("status = 'committed'").select(version), version, "left_semi")


def lineage(spark: SparkSession, versions: DataFrame, at: int) -> DataFrame:
    """(v, depth) of a version and its ancestors over ``versions(v, base)``, which every step reads: hand in a table or a
    persisted frame."""
    return spark.sql(
        """WITH RECURSIVE chain(v, base, depth) AS (
             SELECT v, base, 0 FROM {versions} WHERE v = {at}
             UNION ALL
             SELECT p.v, p.base, chain.depth + 1 FROM chain JOIN {versions} p ON p.v = chain.base)
           SELECT v, depth FROM chain""",
        versions=versions,
        at=at,
    )


def read_branch(log: DataFrame, chain: DataFrame, key: str, value: str, seq: str, version: str) -> DataFrame:
    """Per key the value of the nearest ancestor, then of the highest seq; n counts the visible changes."""
    seen = log.join(chain.withColumnRenamed("v", version), version)
    return seen.groupBy(key).agg(F.max_by(value, F.struct(-F.col("depth"), F.col(seq))).alias(value), F.count("*").alias("n"))


class VersionStore:
    """Staged, committed or aborted versions of a (k, v) map under one folder.

    ``changes/v=N/`` holds the staged rows (seq, k, v); ``manifest/N.json`` exists only once N is committed.
    Readers list the manifest folder, so a version is visible wholly or not at all (N9, N10)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _read(self, p) -> dict:
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def versions(self) -> dict[int, int | None]:
        """Committed versions with their bases; one small file each, as many as versions, not as rows."""
        if not self._fs.exists(self._p("manifest")):
            return {}
        found = (s.getPath() for s in self._fs.listStatus(self._p("manifest")))
        records = [self._read(p) for p in found if p.getName().endswith(".json")]
        return {r["version"]: r["base"] for r in records}

    def create(self, base: int | None = None) -> int:
        """A new version id, claimed by creating its file in ``claims/`` without overwriting: of two writers one gets the id and the
        other tries the next. Claims stay for good, so the id of an aborted version is never given again."""
        claims = self._p("claims")
        self._fs.mkdirs(claims)
        version = max([-1, *(int(s.getPath().getName()) for s in self._fs.listStatus(claims))]) + 1
        while True:
            try:
                self._fs.create(self._p("claims", str(version)), False).close()
                break
            except Py4JJavaError:
                if not self._fs.exists(self._p("claims", str(version))):
                    raise
                version += 1
        self._write(self._p("changes", f"v={version}", "_base.json"), {"version": version, "base": base})
        return version

    def _write(self, p, record: dict) -> None:
        out = self._fs.create(p, False)
        out.write(json.dumps(record).encode())
        out.close()

    def apply(self, version: int, changes: DataFrame) -> None:
        """Appends (seq, k, v) upserts to a staged version."""
        changes.select("seq", "k", "v").write.mode("append").parquet(f"{self.path}/changes/v={version}")

    def commit(self, version: int) -> bool:
        """False if the base is not committed, or the version is committed already or was aborted."""
        staged = self._p("changes", f"v={version}", "_base.json")
        if not self._fs.exists(staged):
            return False
        record, known = self._read(staged), self.versions()
        if version in known or (record["base"] is not None and record["base"] not in known):
            return False
        self._fs.mkdirs(self._p("manifest"))
        temporary = self._p("manifest", f"_{uuid.uuid4().hex}")
        self._write(temporary, record)
        final = self._p("manifest", f"{version}.json")
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:  # without overwriting: of two committers one has made the version
            self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, final, options)
        except Py4JJavaError:
            self._fs.delete(temporary, False)
            if not self._fs.exists(final):
                raise
            return False
        return True

    def abort(self, version: int) -> None:
        if version not in self.versions():
            self._fs.delete(self._p("changes", f"v={version}"), True)

    def read(self, version: int) -> DataFrame:
        """The map as of a version: its own changes (staged or not) over its chain of bases, staged ones too. A version that does
        not exist, was aborted, or stands on one that was, is an error."""
        known = self.versions()
        chain: list[int] = []
        at: int | None = version
        while at is not None:
            chain.append(at)
            if at not in known:
                staged = self._p("changes", f"v={at}", "_base.json")
                if not self._fs.exists(staged):
                    raise ValueError(f"version {version} needs version {at}, which does not exist or was aborted")
                known[at] = self._read(staged)["base"]
            at = known[at]
        log = None
        for depth, v in enumerate(chain):
            parts = [s.getPath().getName() for s in self._fs.listStatus(self._p("changes", f"v={v}"))]
            if any(n.endswith(".parquet") for n in parts):
                rows = self.spark.read.parquet(f"{self.path}/changes/v={v}").withColumn("depth", F.lit(depth))
                log = rows if log is None else log.unionByName(rows)
        if log is None:
            return self.spark.createDataFrame([], "k bigint, v bigint")
        return log.groupBy("k").agg(F.max_by("v", F.struct(-F.col("depth"), F.col("seq"))).alias("v"))

    def compact(self, version: int, path: str, files: int) -> None:
        """Writes the map as of a version as sorted Parquet (extension X)."""
        self.read(version).repartitionByRange(files, "k").sortWithinPartitions("k").write.mode("overwrite").parquet(path)
