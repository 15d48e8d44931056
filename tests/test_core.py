import random
import struct
from collections import OrderedDict

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylog.functions.text import clip_bytes, epoch_ms, from_epoch_ms
from quarrylog.operators import cachesim, keyindex, textindex
from quarrylog.operators.versions import VersionStore
from quarrylog.plans import catalog
from quarrylog.sources import logs, pages
from quarrylog.streaming.logs import stream_logs, windowed_counts

SF = "/root/testdata/sf0.001"


def test_parser_edges(spark):
    lines = ["", "   ", "abc,12abc,x,y", " 5,+7,n", "1,2,n,", "1,2,n,e,extra", '1,2,"a,b",e', "99999999999999999999,3,n,e", "1,zz,n,e", "1,2,n,e\r", "1,,n,e", "-5,2," + "x" * 70 + "," + "y" * 20]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got = {r.i: tuple(r)[1:] for r in logs.parse_lines(df, keep=("i",)).collect()}
    assert 0 not in got
    assert got[1] == (None, None, None, None, True)
    assert got[2] == (None, 12, "x", "y", True)
    assert got[3] == (5, 7, "n", None, False)
    assert got[4] == (1, 2, "n", None, False)
    assert got[5] == (1, 2, "n", "e", False)
    assert got[6] == (1, 2, '"a', 'b"', False)
    assert got[7] == (None, 3, "n", "e", True)
    assert got[8] == (1, 0, "n", "e", False)
    assert got[9] == (1, 2, "n", "e\r", False)
    assert got[10] == (1, 0, "n", "e", False)
    assert got[11] == (-5, 2, "x" * 63, "y" * 15, False)


def test_log_round_trip(spark, tmp_path):
    made = logs.synthetic_logs(spark, 300, 1_700_000_000_000)
    logs.write_logs(made, str(tmp_path / "log"), order="seq", files=3)
    back = logs.read_logs(spark, str(tmp_path / "log"))
    key = ["epoch_ms", "resource_id", "resource_name", "event_type"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, made.select(key).collect()))
    assert back.where("ts_bad").count() == 0
    assert made.select("resource_id", "event_type").distinct().count() == 150
    assert logs.read_logs(spark, str(tmp_path / "absent")).count() == 0


def test_names_are_cut_to_bytes(spark):
    row = logs.parse_lines(spark.createDataFrame([("1,2," + "é" * 40 + "," + "ab🙂" * 4,)], "value string")).first()
    assert row.resource_name == "é" * 31 and row.event_type == "ab🙂ab🙂ab"


def test_running_sums(spark):
    r = random.Random(2)
    keys = sorted({r.choice((-1, 1)) * r.getrandbits(r.choice((5, 20, 40, 62))) for _ in range(500)})
    rows = [(k, r.randint(-9, 9)) for k in keys]
    got = {x.k: x.s for x in keyindex.running_sum(spark.createDataFrame(rows, "k bigint, v bigint"), "k", "v", "s").collect()}
    total, want = 0, {}
    for k, v in rows:
        total += v
        want[k] = total
    assert got == want
    ranks = {x.k: x.r for x in keyindex.dense_rank_of(spark.createDataFrame(rows, "k bigint, v bigint"), "k", "r").collect()}
    assert ranks == {k: i for i, k in enumerate(keys)}


def test_pool_replay(spark):
    """Pinned pages stay, clean and dirty victims, deletes and refetches, failures that take no id."""
    ops = [("fetch", 1, 0), ("fetch", 2, 0), ("new", 0, 0), ("new", 0, 0), ("fetch", 9, 0), ("unpin", 2, 1), ("unpin", 2, 0), ("new", 0, 0), ("delete", 1, 0), ("unpin", 1, 0), ("delete", 1, 0), ("delete", 1, 0), ("flush", 1, 0), ("flush", 50, 0), ("flush", 50, 0), ("all", 0, 0), ("fetch", 1, 0), ("fetch", 1, 0), ("unpin", 77, 0)]
    rows = [("p", i, op, p, bool(x)) for i, (op, p, x) in enumerate(ops)] + [("q", 0, "fetch", 5, False)]
    df = spark.createDataFrame(rows, "pool string, seq bigint, op string, page_id bigint, dirty boolean")
    got = [tuple(r)[2:] for r in sorted(cachesim.pool_replay(df, 3, 50).where("pool = 'p'").collect(), key=lambda r: r.seq)]
    assert got == [
        (True, 1, None, 0, 1), (True, 2, None, 0, 1), (True, 50, None, 0, 1), (False, None, None, 0, None), (False, 9, None, 0, None), (True, 2, None, 0, 0), (False, 2, None, 0, 0),
        (True, 51, 2, 1, 1), (False, 1, None, 0, 1), (True, 1, None, 0, 0), (True, 1, None, 0, None), (True, 1, None, 0, None), (False, 1, None, 0, None), (True, 50, None, 1, 1),
        (True, 50, None, 1, 1), (True, None, None, 1, None), (True, 1, None, 0, 1), (True, 1, None, 0, 2), (False, 77, None, 0, None),
    ]
    assert cachesim.pool_replay(df.limit(0), 3).count() == 0


def test_page_files(spark, tmp_path):
    rows = [(i, i - 1, 2**31 + i, i % 2 == 0, f"val:{i}".encode()) for i in range(250)] + [(None, None, None, None, None), (2**31 - 1, -5, 0, True, b"x" * 5000)]
    df = spark.createDataFrame(rows, "page_id int, creation_version int, key_count bigint, is_leaf boolean, payload binary")
    assert pages.write_page_files(df, str(tmp_path / "db"), 3) == len(rows)
    got = {r.page_id: r for r in pages.read_page_files(spark, str(tmp_path / "db")).collect()}
    for i, v, n, leaf, text in rows[:250]:
        assert (got[i].creation_version, got[i].key_count, got[i].is_leaf, bytes(got[i].payload).rstrip(b"\0")) == (v, n, leaf, text)
    assert bytes(got[2**31 - 1].payload) == b"x" * 4080 and got[-1].key_count == 0 and len(got) == len(rows)
    assert pages.write_page_files(df.limit(0), str(tmp_path / "none")) == 0 and pages.read_page_files(spark, str(tmp_path / "none")).count() == 0


def test_no_single_task_windows(spark):
    for name in ("q10_leaf_stats", "q11_leaf_skip", "q23_lru_replay", "q24_cache_size", "q32_index_levels"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert "SinglePartition, REPARTITION" not in plan and not any("], []" in w for w in windows)


def test_optional_part_without_its_needs(monkeypatch):
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("quarrylog.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)


def test_times_and_bytes(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.999500' a, 'éé' b, 'abc' c").select(epoch_ms(F.col("a")), from_epoch_ms(F.lit(-1)).cast("string"), clip_bytes(F.col("b"), 3), clip_bytes(F.col("c"), 2)).first()
    assert list(row) == [-1, "1969-12-31 23:59:59.999", "é", "ab"]
    assert spark.range(1).select(from_epoch_ms(F.lit(9223372036854775807))).first()[0] is None


def test_dense_rank_and_leaves(spark):
    keys = random.Random(1).sample(range(-200_000, 400_000), 1234)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    ranks = {r.k: r.r for r in keyindex.dense_rank_of(df, "k", "r").collect()}
    assert ranks == {k: i for i, k in enumerate(sorted(keys))}
    leaves = sorted(keyindex.leaf_stats(df, "k").collect())
    assert [r.key_count for r in leaves] == [100] * 12 + [34]
    assert [r.next_leaf for r in leaves] == [*range(1, 13), None]


def test_upsert_tombstone(spark):
    df = spark.createDataFrame([(1, 10, 1, False), (1, 11, 2, False), (2, 20, 3, False), (2, None, 4, True)], "k int, v int, s int, gone boolean")
    assert [tuple(r) for r in keyindex.upsert(df, "k", "v", "s", "gone").collect()] == [(1, 11, 2)]


def test_trie(spark):
    words = spark.createDataFrame([("to",), ("tea",), ("ten",), ("",), ("tea",), (None,)], "w string")
    nodes = {r.prefix: (r.subtree_terminals, r.is_terminal) for r in textindex.prefix_rollup(words, "w").collect()}
    assert nodes[""] == (4, 1) and nodes["te"] == (2, 0) and nodes["tea"] == (1, 1)
    assert {r.prefix: r.edges for r in textindex.children(words, "w").collect()} == {"": "t", "t": "eo", "te": "an"}
    changes = spark.createDataFrame([("tea", -1), ("tent", 1)], "word string, delta int")
    after = {r.prefix: (r.subtree_terminals, r.is_terminal) for r in textindex.adjust_counts(textindex.prefix_rollup(words, "w"), changes).collect()}
    live = textindex.prefix_rollup(spark.createDataFrame([("to",), ("ten",), ("tent",), ("",)], "w string"), "w")
    assert after == {r.prefix: (r.subtree_terminals, r.is_terminal) for r in live.collect()}
    assert {r.prefix: r.words for r in textindex.prefix_counts(words, "w", ["te", "x", ""]).collect()} == {"te": 2, "x": 0, "": 4}


def test_version_store(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(r, "seq bigint, k bigint, v bigint")
    get = lambda v: {r.k: r.v for r in store.read(v).collect()}
    a = store.create()
    store.apply(a, rows((1, 1, 10), (2, 2, 20), (3, 1, 11)))
    b = store.create(a)
    assert not store.commit(b)  # its base is staged only
    assert store.commit(a) and not store.commit(a)
    store.apply(b, rows((1, 2, 99)))
    c = store.create(a)
    store.apply(c, rows((1, 3, 30)))
    assert get(b) == {1: 11, 2: 99} and get(c) == {1: 11, 2: 20, 3: 30}
    store.abort(c)
    assert store.create(a) == c + 1  # the id of an aborted version is never given again
    with pytest.raises(ValueError):
        store.read(c)
    d = store.create(b)
    store.apply(d, rows((1, 9, 9)))
    assert get(d) == {1: 11, 2: 99, 9: 9}  # staged on staged
    assert not store.commit(c) and store.commit(b)
    assert set(store.versions()) == {a, b} and get(b) == {1: 11, 2: 99}


def test_page_file(spark, tmp_path):
    page = lambda i, text: struct.pack("<iiIB3x", i, 0, 7, 1) + text.ljust(4080, b"\0")
    (tmp_path / "db").write_bytes(page(0, b"Version_2") + page(-1, b"x")[:100])
    got = sorted(pages.read_page_file(spark, str(tmp_path / "db")).collect(), key=lambda r: r.slot)
    assert [(r.slot, r.page_id, r.key_count, r.is_leaf, len(r.payload)) for r in got] == [(0, 0, 7, True, 4080), (1, -1, 7, True, 4080)]
    assert bytes(got[0].payload).rstrip(b"\0") == b"Version_2"
    wanted = spark.createDataFrame([(0,), (5,)], "page_id int")
    read = {r.page_id: bytes(r.payload) for r in pages.page_or_zero(pages.read_page_file(spark, str(tmp_path / "db")), wanted).collect()}
    assert read[5] == bytes(4080) and read[0].startswith(b"Version_2")
    assert sorted(r.page_id for r in pages.allocate_ids(spark.range(3), 9, "id").collect()) == [10, 11, 12]


@pytest.mark.parametrize("ops,victims", [("U1 U2 U3 V V V V", [1, 2, 3, None]), ("U1 U2 U3 U4 U5 P3 P4 V V V V", [1, 2, 5, None]), ("U1 U2 U3 P1 U1 V V V", [2, 3, 1]), ("U1 U2 U1 P9 V", [1])])
def test_frame_replay(spark, ops, victims):
    rows = [("p", i, o[0], int(o[1:] or 0)) for i, o in enumerate(ops.split())]
    got = sorted(cachesim.frame_replay(spark.createDataFrame(rows, "pool string, seq bigint, op string, frame_id bigint"), 7).collect(), key=lambda r: r.seq)
    assert [r.victim for r in got if r.op == "V"] == victims


def test_lru_replay_segments(spark):
    r = random.Random(3)
    trace = [(i, int(r.paretovariate(0.7)) % 60) for i in range(2000)]
    cache, want = OrderedDict(), {}
    for t, p in trace:
        want[t] = p in cache
        cache.pop(p, None)
        cache[p] = True
        if len(cache) > 10:
            cache.popitem(last=False)
    got = cachesim.lru_replay(spark.createDataFrame(trace, "t bigint, p bigint"), "t", "p", 10, segment=300)
    assert {x.t: x.hit for x in got.collect()} == want


@pytest.mark.parametrize("segment", [20, 2])
def test_lru_replay_groups_of_segments(spark, monkeypatch, segment):
    """More segments than a group carries, and more groups than that: the caches come from the levels above."""
    monkeypatch.setattr(cachesim, "GROUP", 4)
    r = random.Random(4)
    trace = [(i * 7, int(r.paretovariate(0.7)) % 60 + i // 100) for i in range(400)]
    cache, want = OrderedDict(), {}
    for t, p in trace:
        want[t] = p in cache
        cache.pop(p, None)
        cache[p] = True
        if len(cache) > 10:
            cache.popitem(last=False)
    got = cachesim.lru_replay(spark.createDataFrame(trace, "t bigint, p bigint"), "t", "p", 10, segment=segment)
    assert {x.t: x.hit for x in got.collect()} == want


def test_streaming(spark, tmp_path):
    logs.write_logs(logs.synthetic_logs(spark, 1200, 1_700_000_040_000), str(tmp_path / "in"))
    counts = windowed_counts(stream_logs(spark, str(tmp_path / "in")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 1200


def test_pushdown(spark):
    plan = catalog.q09_range_scan(spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,1000)" in plan
    assert "StringStartsWith(p_name,re)" in catalog.q14_prefix_search(spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer", "orders", "part", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    text = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    clean = lambda rows: [r.replace(".0,", ",").replace(".0]", "]") for r in rows]
    assert sorted(got.columns) == sorted(want.columns) and clean(text(got)) == clean(text(want))
