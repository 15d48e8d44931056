"""Ordered integer keys: lookups, ranges, leaf statistics, block skipping, upserts.

A sorted Parquet layout takes the place of the tree: row-group min/max statistics do the descent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LEAF_KEYS = 100
FANOUT = 101
BITS = 16


def point_lookup(df: DataFrame, key: str, value: int) -> DataFrame:
    return df.where(F.col(key) == value)


def range_scan(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Closed range; reaches the scan as two pushed filters."""
    return df.where(F.col(key).between(low, high))


def write_sorted(df: DataFrame, key: str, path: str, files: int) -> None:
    """Range-partitioned and sorted, so that lookups skip files and row groups."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def dense_rank_of(df: DataFrame, key: str, name: str) -> DataFrame:
    """0-based global rank of a unique BIGINT key without a global sort: rows are ranked inside key blocks
    of 65,536, and block sizes are prefix-summed level by level. NULL keys rank nowhere and go."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_block", F.shiftright(F.col(key).cast("bigint"), BITS))
    starts = running_sum(rows.groupBy("_block").agg(F.count("*").alias("_n")), "_block", "_n", "_end")
    inside = F.row_number().over(W.partitionBy("_block").orderBy(key)) - 1
    placed = rows.withColumn("_in", inside).join(starts, "_block")
    return placed.withColumn(name, (F.col("_end") - F.col("_n") + F.col("_in")).cast("bigint")).drop("_block", "_in", "_end", "_n")


def running_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, value, name): running sums of a BIGINT value over a unique BIGINT key, whatever its range. Sums run inside groups
    of at most 65,536 keys, group totals inside groups of groups, and at the top there are at most 65,536
    rows, so that no task's share grows with the table."""
    rows = df.select(key, value, F.shiftright(F.col(key), BITS).alias("_1")).withColumn("_2", F.shiftright("_1", BITS)).withColumn("_3", F.shiftright("_2", BITS))
    ones = rows.groupBy("_1", "_2", "_3").agg(F.sum(value).alias("_s"))
    twos = ones.groupBy("_2", "_3").agg(F.sum("_s").alias("_s"))
    threes = twos.groupBy("_3").agg(F.sum("_s").alias("_s"))

    def before(table: DataFrame, group: list[str], order: str, out: str) -> DataFrame:
        return table.select(order, (F.sum("_s").over(W.partitionBy(*group).orderBy(order)) - F.col("_s")).alias(out))

    # the top level: one group per sign bit, its other half's total added
    top = before(threes.withColumn("_g", F.col("_3") >= 0), ["_g"], "_3", "_b3")
    below = threes.where("_3 < 0").agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("_neg")).withColumn("_g", F.lit(True))
    top = top.withColumn("_g", F.col("_3") >= 0).join(F.broadcast(below), "_g", "left").select("_3", (F.col("_b3") + F.coalesce("_neg", F.lit(0))).alias("_b3"))
    inner = F.sum(value).over(W.partitionBy("_1").orderBy(key))
    out = rows.withColumn("_in", inner).join(before(ones, ["_2"], "_1", "_b1"), "_1").join(before(twos, ["_3"], "_2", "_b2"), "_2").join(top, "_3")
    return out.select(key, value, (F.col("_in") + F.col("_b1") + F.col("_b2") + F.col("_b3")).cast("bigint").alias(name))


def leaf_stats(df: DataFrame, key: str, leaf_keys: int = LEAF_KEYS) -> DataFrame:
    """Per leaf of ``leaf_keys`` keys: count, min, max, density, next leaf (dense blocks, decision N7)."""
    leaves = dense_rank_of(df.select(key), key, "_rank").withColumn("leaf_no", F.floor(F.col("_rank") / F.lit(leaf_keys)).cast("bigint"))
    stats = leaves.groupBy("leaf_no").agg(
        F.count("*").alias("key_count"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), (F.count("*") / F.lit(float(leaf_keys))).alias("density")
    )
    # leaves are numbered densely, so the chain is leaf_no + 1, up to the leaf that the number of keys gives
    last = (df.where(F.col(key).isNotNull()).count() - 1) // leaf_keys
    return stats.withColumn("next_leaf", F.when(F.col("leaf_no") < last, F.col("leaf_no") + 1))


def index_levels(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes above leaf_stats() rows, level by level up to the root (B2, B9, B11): level (0 for leaves), node_no,
    parent_no (NULL for the root), children (0 for leaves), min_key, max_key. A level has 1 / fanout of the rows of the one
    below; the number of levels follows from one count."""
    level = leaves.select(F.lit(0).alias("level"), F.col("leaf_no").alias("node_no"), F.lit(0).cast("bigint").alias("children"), "min_key", "max_key")
    n, out, at = leaves.count(), None, 0
    while True:
        parent = F.floor(F.col("node_no") / F.lit(fanout)).cast("bigint")
        named = level.withColumn("parent_no", parent if n > 1 else F.lit(None).cast("bigint"))
        out = named if out is None else out.unionByName(named)
        if n <= 1:
            return out
        at, n = at + 1, -(-n // fanout)
        level = level.groupBy(parent.alias("node_no")).agg(F.count("*").alias("children"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key")).withColumn("level", F.lit(at))


def visited(nodes: DataFrame, low: int, high: int) -> DataFrame:
    """The nodes that a closed range query reads: a skipped node's whole subtree goes unread (B6). From the root down, each
    level is joined with the read nodes above it."""
    top = nodes.agg(F.max("level")).first()[0] or 0
    read, out = None, None
    for level in range(top, -1, -1):
        here = nodes.where((F.col("level") == level) & ~should_skip(low, high))
        read = here if read is None else here.join(read.select(F.col("node_no").alias("parent_no")), "parent_no", "left_semi").select(*nodes.columns)
        out = read if out is None else out.unionByName(read)
    return out


def should_skip(low: int, high: int, min_key: str = "min_key", max_key: str = "max_key") -> Column:
    """Zone-map test for a closed query range (decision N5)."""
    return (F.col(max_key) < low) | (F.col(min_key) > high)


def upsert(log: DataFrame, key: str, value: str, seq: str, tombstone: str | None = None) -> DataFrame:
    """Last write wins per key: one hash aggregate with map-side combine. With ``tombstone`` (a boolean
    column), keys whose last write is a delete go (extension X to B13)."""
    last = F.max_by(F.struct(F.col(value), *([F.col(tombstone)] if tombstone else [])), seq)
    out = log.groupBy(key).agg(last.alias("_w"), F.max(seq).alias("last_seq"))
    if tombstone:
        out = out.where(~F.coalesce(F.col(f"_w.{tombstone}"), F.lit(False)))
    return out.select(key, F.col(f"_w.{value}").alias(value), "last_seq")
