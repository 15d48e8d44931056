"""Embedding near-duplicates (5): random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors of one label are one class with a multiplicity. A class's code in a table is the signs of ``bits`` random
projections; classes with equal label and code in some table are compared exactly, in double precision. ``bits`` follows
the number of classes (regions stay small), and the number of tables follows from ``bits`` and the
threshold so that a pair right at the threshold meets in no table with probability below 1e-8; so nothing
below it is linked, and above it practically nothing is missed.

A region of any size is cut into blocks of 512, and every pair of blocks is a cell, so a task's memory is bounded and no
candidate is dropped. A cell counts each linked pair only in the first table that the pair shares (codes travel
with the vectors), and returns per class the number of links and one edge to the smallest class it is linked with in its
local component: never the list of pairs.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.llm.common import by_value, written
from quarrylog.llm.components import components

CELL = 512
MISS = 1e-8
SEED = 77

by_value(__name__)


def tables_for(bits: int, threshold: float, miss: float = MISS) -> int:
    """Tables needed so that a pair at the threshold is missed with probability below ``miss``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def _fit(vector: str, label: str) -> Column:
    """True for rows that can link: label and vector given, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _classes(rows: DataFrame) -> DataFrame:
    """(vec_id, node, label, v) with node the 128-bit hash of label and vector; v as float64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(np.array(v, np.float64) + 0.0).tobytes() for v in batch.column("v").to_pylist()]
            nodes = [xxhash.xxh3_128_digest(k.encode() + b"\0" + r) for k, r in zip(batch.column("label").to_pylist(), raw)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.binary()), batch.column("label"), pa.array(raw, pa.binary())], ["vec_id", "node", "label", "v"])

    return rows.mapInArrow(run, "vec_id bigint, node binary, label string, v binary")


def _codes(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds codes: ``tables`` 64-bit values, each a hash of ``bits`` signs."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        power = np.uint64(1) << np.arange(min(bits, 63), dtype=np.uint64)
        for batch in batches:
            raw = batch.column("v").to_pylist()
            codes = []
            for r in raw:
                v = np.frombuffer(r)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([SEED, len(v)]).standard_normal((tables * bits, len(v)))
                signs = (planes[len(v)] @ v > 0).reshape(tables, bits)[:, :63]
                codes.append((signs @ power).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "label", "v", "n")] + [pa.array(codes, pa.binary())], ["node", "label", "v", "n", "codes"])

    return classes.mapInArrow(run, "node binary, label string, v binary, n bigint, codes binary")


def _links(coded: DataFrame, tables: int, threshold: float) -> DataFrame:
    """(node, links, a, b): links to other classes counted with multiplicity, and component edges."""

    def spread(batches):
        for batch in batches:
            n = len(batch)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<i8").reshape(n, tables) if n else np.zeros((0, tables), "<i8")
            dims = np.repeat(np.array([len(v) // 8 for v in batch.column("v").to_pylist()], np.int32), tables)
            at = np.repeat(np.arange(n), tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(at)), batch.column("label").take(pa.array(at)), pa.array(dims), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(codes.ravel())], ["node", "label", "dim", "t", "code"]
            )

    region = ["label", "dim", "t", "code"]
    keyed = coded.mapInArrow(spread, "node binary, label string, dim int, t int, code bigint")
    sizes = keyed.groupBy(*region).agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / F.lit(CELL)).cast("int"))
    rows = keyed.join(sizes, region).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = rows.select(*region, "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    keys = [*region, "i", "j"]
    placed = cells.join(coded.select("node", "v", "n", "codes"), "node").repartition(*keys).sortWithinPartitions(*keys, "node")

    def compare(batches):
        group, held = None, []

        def flush():
            if len(held) < 2:
                return []
            t, i, j = group[2], group[4], group[5]
            nodes = [h[0] for h in held]
            x = np.frombuffer(b"".join(h[1] for h in held)).reshape(len(held), -1)
            x = x / np.abs(x).max(1)[:, None]  # no overflow or underflow of squares
            x = x / np.sqrt((x * x).sum(1))[:, None]
            many = np.array([h[2] for h in held])
            codes = np.frombuffer(b"".join(h[3] for h in held), "<i8").reshape(len(held), -1)
            block = np.array([h[4] for h in held])
            counts, edges = np.zeros(len(held), np.int64), []
            left, right = (np.arange(len(held)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
            if not len(left) or not len(right):
                return []
            p, q = np.nonzero(x[left] @ x[right].T >= threshold)
            p, q = left[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            for lo in range(0, len(p), 1 << 16):
                a, b = p[lo : lo + (1 << 16)], q[lo : lo + (1 << 16)]
                fresh = ~(codes[a, :t] == codes[b, :t]).any(1)
                a, b = a[fresh], b[fresh]
                np.add.at(counts, a, many[b])
                np.add.at(counts, b, many[a])
                edges.append((a, b))
            root = list(range(len(held)))

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for a, b in edges:
                for k, m in zip(a.tolist(), b.tolist()):
                    k, m = find(k), find(m)
                    root[max(k, m)] = min(k, m)
            return [(nodes[k], int(counts[k]), nodes[k], nodes[find(k)]) for k in range(len(held)) if counts[k]]

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.binary())], ["node", "links", "a", "b"])

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "node", "v", "n", "codes", "block")]
            for *key, node, v, n, codes, block in zip(*columns):
                if key != group:
                    out += flush()
                    group, held = key, []
                held.append((node, v, n, codes, block))
            yield table(out)
        yield table(flush())

    return placed.mapInArrow(compare, "node binary, links bigint, a binary, b binary")


def near_duplicates(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links join rows of equal labels with cosine >= threshold.

    Vectors that are NULL, empty, zero, or hold NULL or a non-finite component, and rows without a label, link with
    nothing. Repeated rows link with each other. A NULL vec_id keeps its links but has a NULL component if it is
    alone. Vectors of different lengths never link."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    good = written(_classes(rows.where(_fit("v", "label"))), "vectors")
    classes = written(good.groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least")), "classes")
    count = classes.count()
    bits = min(40, max(8, math.ceil(math.log2(count + 1))))
    tables = tables_for(bits, threshold)
    coded = written(_codes(classes.select("node", "label", "v", "n"), bits, tables), "codes")
    found = written(_links(coded, tables, threshold), "links")
    groups = components(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "n", "least").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(roots, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "node").join(answer, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where(~_fit("v", "label")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
