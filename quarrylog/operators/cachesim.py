"""Least-recently-used replay: cache hits, the replacer's operations, the buffer pool's operations.

A hit trace is cut into segments. The cache at a segment's start holds the ``capacity`` most recent distinct
pages before it, so it follows from per-segment summaries of at most ``capacity`` rows, which are carried forward in
groups, level by level; segments are then replayed side by side. No task sees the whole trace. Replayed operations
depend on all before them in their pool: pools run side by side, and a pool streams through its task.
"""

from __future__ import annotations

from collections import OrderedDict
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from quarrylog.operators.keyindex import dense_rank_of
from quarrylog.session import work_dir

GROUP = 64


def _latest(rows: DataFrame, by: str, capacity: int) -> DataFrame:
    """(by, p, t): of each value of ``by`` the ``capacity`` most recent distinct pages."""
    last = rows.groupBy(by, "p").agg(F.max("t").alias("t"))
    return last.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("t")))).where(F.col("r") <= capacity).drop("r")


def _carried(recent: DataFrame, capacity: int) -> DataFrame:
    """(seg, p, t): the cache before each segment, of summaries(seg, p, t). A task carries ``GROUP`` summaries forward; what
    stands before a group comes from the groups' summaries, carried the same way. Summaries are read by several steps: they are
    written once, which also makes their columns others than those of the trace that they are matched with."""
    path = f"{work_dir(recent.sparkSession, 'recent')}/recent"
    recent.write.parquet(path)
    recent = recent.sparkSession.read.schema(recent.schema).parquet(path)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        cache: OrderedDict = OrderedDict()
        now, out = None, []
        pdf = pdf.sort_values(["seg", "t"])
        for seg, p, t in zip(pdf["seg"], pdf["p"], pdf["t"]):
            if seg != now:
                now = seg
                out += [(seg, q, u) for q, u in cache.items()]
            cache.pop(p, None)
            cache[p] = t
            if len(cache) > capacity:
                cache.popitem(last=False)
        return pd.DataFrame(out, columns=["seg", "p", "t"]).astype("int64")

    grouped = recent.withColumn("g", F.floor(F.col("seg") / F.lit(GROUP)).cast("bigint"))
    inside = grouped.groupBy("g").applyInPandas(carry, "seg bigint, p bigint, t bigint")
    ends = grouped.agg(F.min("g"), F.max("g")).first()
    if ends[0] == ends[1]:
        return inside
    outer = _carried(_latest(grouped, "g", capacity).withColumnRenamed("g", "seg"), capacity).withColumnRenamed("seg", "g")
    all_before = grouped.select("seg", "g").distinct().join(outer, "g").select("seg", "p", "t").unionByName(inside)
    return _latest(all_before, "seg", capacity)


def lru_replay(trace: DataFrame, seq: str, page: str, capacity: int, segment: int = 100_000) -> DataFrame:
    """Hit flag per access, every access unpinned at once; ``seq`` is a unique BIGINT, rows with a NULL in
    either column go. ``segment`` is the number of accesses in a segment, however sparse seq is."""
    rows = trace.where(F.col(seq).isNotNull() & F.col(page).isNotNull()).select(F.col(seq).alias("t"), F.col(page).alias("p"))
    rows = dense_rank_of(rows, "t", "rank").select(F.floor(F.col("rank") / F.lit(segment)).cast("bigint").alias("seg"), "t", "p")
    carried = _carried(_latest(rows, "seg", capacity), capacity)

    def replay(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        cache: OrderedDict = OrderedDict((p, True) for p in start.sort_values("t")["p"])
        own = own.sort_values("t")
        hits = []
        for p in own["p"]:
            hit = p in cache
            hits.append(hit)
            if hit:
                cache.move_to_end(p)
            else:
                cache[p] = True
                if len(cache) > capacity:
                    cache.popitem(last=False)
        return pd.DataFrame({"t": own["t"], "p": own["p"], "hit": hits})

    return rows.groupBy("seg").cogroup(carried.groupBy("seg")).applyInPandas(replay, "t bigint, p bigint, hit boolean")


def _streamed(ops: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str, names: list[str]) -> DataFrame:
    """Operations of each pool in the order of seq, through a machine that ``make`` gives; its answer is added to
    (pool, seq). A task holds one batch and one pool's state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, step = None, None
        for pdf in batches:
            out = []
            for row in pdf[["pool", "seq", *columns]].itertuples(index=False, name=None):
                if step is None or row[0] != pool:
                    pool, step = row[0], make()
                out.append((row[0], row[1], *step(*row[2:])))
            made = pd.DataFrame(out, columns=["pool", "seq", *names])
            yield made.astype({c: "Int64" for c in names if f"{c} bigint" in schema})

    return ops.select("pool", "seq", *columns).repartition("pool").sortWithinPartitions("pool", "seq").mapInPandas(run, f"pool {ops.schema['pool'].dataType.simpleString()}, seq bigint, {schema}")


def frame_replay(ops: DataFrame, capacity: int | None = None) -> DataFrame:
    """Replays U(npin), P(in) and V(ictim) operations on an evictable set, per ``pool``: returns each victim
    request with its frame (NULL if the set is empty) and the set's size after every operation.

    ``ops(pool, seq, op, frame_id)``, pool not NULL; a repeated U does not refresh, P of an absent frame does nothing,
    ``capacity`` is accepted and ignored."""

    def make():
        held: OrderedDict = OrderedDict()

        def step(op, frame):
            victim = None
            if op == "U":
                held.setdefault(frame, True)
            elif op == "P":
                held.pop(frame, None)
            elif held:
                victim = held.popitem(last=False)[0]
            return op, victim, len(held)

        return step

    return _streamed(ops, ["op", "frame_id"], make, "op string, victim bigint, size bigint", ["op", "victim", "size"])


def pool_replay(ops: DataFrame, capacity: int, first_new: int = 0) -> DataFrame:
    """Replays a buffer pool's operations (C1-C8), per ``pool``, starting empty: ops(pool, seq, op, page_id, dirty) with op

    * fetch: a resident page gets a pin more; else it takes a free frame or that of the page that has been unpinned for longest,
      which is written if dirty; pinned once and clean. Not ok where all frames are pinned.
    * new: the same for the next page id (from ``first_new`` on; a failure takes none), pinned once and dirty.
    * unpin: a pin less, dirty if asked, evictable at none; not ok if absent or without pins.
    * flush: written even if clean or pinned; not ok if absent. all: every dirty page is written.
    * delete: dropped without writing; ok if absent, not if pinned.

    Returns pool, seq, ok, page_id (the id that new gave), victim (the page put out, or NULL), writes (pages written by this
    operation; their sum is the pool's write counter, S11) and pins (of the page afterwards, NULL if absent)."""

    def make():
        pages: dict = {}  # page: [pins, dirty]
        idle: OrderedDict = OrderedDict()  # pages without pins, by the time of the last unpin
        following = [first_new]

        def take(page, dirty):
            victim, writes = None, 0
            if len(pages) >= capacity:
                if not idle:
                    return False, None, 0
                victim = idle.popitem(last=False)[0]
                writes = int(pages.pop(victim)[1])
            pages[page] = [1, dirty]
            return True, victim, writes

        def step(op, page, dirty):
            ok, victim, writes, own = True, None, 0, pages.get(page)
            if op == "fetch":
                if own:
                    own[0] += 1
                    idle.pop(page, None)
                else:
                    ok, victim, writes = take(page, False)
            elif op == "new":
                page = following[0]
                ok, victim, writes = take(page, True)
                following[0] += ok
                page = page if ok else None
            elif op == "unpin":
                ok = bool(own) and own[0] > 0
                if ok:
                    own[0] -= 1
                    own[1] = own[1] or bool(dirty)
                    if not own[0]:
                        idle[page] = True
            elif op == "flush":
                ok, writes = bool(own), int(bool(own))
                if own:
                    own[1] = False
            elif op == "delete":
                ok = not own or not own[0]
                if own and ok:
                    pages.pop(page)
                    idle.pop(page)
            elif op == "all":
                page, writes = None, sum(p[1] for p in pages.values())
                for p in pages.values():
                    p[1] = False
            return bool(ok), page, victim, writes, pages[page][0] if page in pages else None

        return step

    return _streamed(ops, ["op", "page_id", "dirty"], make, "ok boolean, page_id bigint, victim bigint, writes bigint, pins bigint", ["ok", "page_id", "victim", "writes", "pins"])
