"""Queries q01-q34 (q01-q23: SURVEY 7.3) with their DuckDB oracles, plus extensions marked X.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole tables it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog.functions.text import clip_bytes, clip_chars, epoch_ms, from_epoch_ms
from quarrylog.operators import cachesim, keyindex, textindex, versions
from quarrylog.schema import EVENT_CHARS, NAME_BYTES, NAME_CHARS
from quarrylog.session import table, work_dir
from quarrylog.sources import logs, pages

VERSION_ROWS = 1000
CACHE_PAGES = 100
POOLS = 50
POOL_PAGES = 5
FIRST_NEW = 100
PREFIXES = ["re", "s", "zz", ""]


def _log(spark: SparkSession, d: str) -> DataFrame:
    e, c = table(spark, d, "events"), table(spark, d, "customer")
    return e.join(c, e.user_id == c.c_custkey).select(
        "event_id",
        epoch_ms(F.col("ts")).alias("epoch_ms"),
        F.col("user_id").alias("resource_id"),
        clip_chars(F.col("c_name"), NAME_CHARS).alias("resource_name"),
        clip_chars(F.col("event_type"), EVENT_CHARS).alias("event_type"),
    )


def q01_log_scan(spark, d):
    """M1: typed log records."""
    return _log(spark, d)


def q02_log_line(spark, d):
    """Records as CSV lines."""
    return _log(spark, d).select("event_id", logs.log_line().alias("line"))


def q03_log_parse(spark, d):
    """Lines parsed back into typed columns."""
    parsed = logs.parse_lines(q02_log_line(spark, d), "line", keep=("event_id",))
    return parsed.select("event_id", from_epoch_ms(F.col("epoch_ms")).alias("ts"), "resource_id", "resource_name", "event_type")


def q04_log_truncate(spark, d):
    """Bounded copies, in characters."""
    return table(spark, d, "documents").select("doc_id", clip_chars(F.col("text"), NAME_CHARS).alias("name63"), clip_chars(F.col("source"), EVENT_CHARS).alias("event15"))


def q05_synthetic_logs(spark, d):
    """The deterministic generator."""
    return logs.synthetic_logs(spark, 10_000, 1_700_000_000_000)


def q06_log_summary(spark, d):
    """X over M1: parsed lines summarised per resource and event type."""
    parsed = logs.parse_lines(q02_log_line(spark, d), "line")
    return parsed.groupBy("resource_id", "event_type").agg(F.count("*").alias("n"), F.min("epoch_ms").alias("first_ms"), F.max("epoch_ms").alias("last_ms"))


def q07_id_name_map(spark, d):
    """Names per resource id."""
    return _log(spark, d).groupBy("resource_id").agg(F.count_distinct("resource_name").alias("names"))


def q08_point_lookup(spark, d):
    """B4 (declared only): equality on the key."""
    return keyindex.point_lookup(table(spark, d, "orders"), "o_orderkey", 4242).select("o_orderkey", "o_custkey", "o_totalprice")


def q09_range_scan(spark, d):
    """B5 (declared): closed key range."""
    return keyindex.range_scan(table(spark, d, "orders"), "o_orderkey", 1000, 1999).select("o_orderkey", "o_custkey", "o_totalprice")


def q10_leaf_stats(spark, d):
    """B3, B5, B10, B12 (declared): statistics of dense leaves of 100 keys."""
    return keyindex.leaf_stats(table(spark, d, "orders"), "o_orderkey")


def q11_leaf_skip(spark, d):
    """B6 (declared): zone-map test per leaf."""
    return q10_leaf_stats(spark, d).select("leaf_no", "min_key", "max_key", keyindex.should_skip(1050, 1949).alias("skip"))


def q12_upsert(spark, d):
    """B7, V3 (declared): last write wins."""
    return keyindex.upsert(table(spark, d, "events"), "user_id", "value", "event_id")


def q13_trie_get(spark, d):
    """T2, T4 (declared): value of one word."""
    return textindex.exact_get(table(spark, d, "part"), "p_name", "p_partkey", "small ring")


def q14_prefix_search(spark, d):
    """T11 (implied): words with a prefix."""
    return textindex.prefix_search(table(spark, d, "part"), "p_name", "re")


def q15_prefix_count(spark, d):
    """T5 (declared): words under given prefixes, zeros kept."""
    return textindex.prefix_counts(table(spark, d, "part"), "p_name", PREFIXES)


def q16_trie_nodes(spark, d):
    """T3, T5 (declared): all prefixes."""
    return textindex.prefix_rollup(table(spark, d, "part"), "p_name")


def q17_trie_children(spark, d):
    """T7 (declared): sorted edges per prefix."""
    return textindex.children(table(spark, d, "part"), "p_name")


def _versioned(spark, d):
    return table(spark, d, "events").select("user_id", "value", "event_id", F.floor(F.col("event_id") / F.lit(VERSION_ROWS)).cast("bigint").alias("version"))


def q18_as_of(spark, d):
    """V6 (declared): the map as of version 4."""
    return versions.as_of(_versioned(spark, d), "user_id", "value", "event_id", "version", 4)


def q19_commit_visibility(spark, d):
    """V4, V5 (declared): aborted versions (id % 3 = 2) are not seen, as of version 7."""
    log = _versioned(spark, d)
    status = log.select("version").distinct().withColumn("status", F.when(F.col("version") % 3 == 2, "aborted").otherwise("committed"))
    return versions.as_of(versions.committed(log, status, "version"), "user_id", "value", "event_id", "version", 7)


def q20_version_lineage(spark, d):
    """V3, V6 (declared): branching bases, read at version 7."""
    log = _versioned(spark, d)
    v = F.col("version")
    # one row a version, read by every step of the recursion: computed once
    tree = log.select("version").distinct().persist().select(v.alias("v"), F.when(v == 0, F.lit(None)).when(v % 2 == 0, v - 2).otherwise(v - 1).alias("base"))
    return versions.read_branch(log, versions.lineage(spark, tree, 7), "user_id", "value", "event_id", "version")


def q21_page_map(spark, d):
    """Page and byte offset of each key."""
    return pages.with_page(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def q22_page_version(spark, d):
    """B8, V7 (declared): newest version and keys per block of 100 keys."""
    log = _versioned(spark, d).withColumn("block", pages.page_of(F.col("user_id")))
    return log.groupBy("block").agg(F.max("version").alias("creation_version"), F.count_distinct("user_id").alias("keys"))


def q23_lru_replay(spark, d):
    """Hit flag of each access in a cache of 100 pages."""
    hits = cachesim.lru_replay(table(spark, d, "events"), "event_id", "user_id", CACHE_PAGES, segment=25_000)
    return hits.select(F.col("t").alias("event_id"), F.col("p").alias("page_id"), "hit")


def q24_cache_size(spark, d):
    """Evictable frames over time when each user's first and last event are unpin and pin, as a
    running sum of +1 and -1 per 100 event ids, summed level by level."""
    e = table(spark, d, "events")
    span = e.groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    steps = span.select(F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("step")), F.struct((F.col("b") + 1).alias("t"), F.lit(-1).alias("step")))).alias("s")).select("s.*")
    moved = steps.groupBy(F.floor(F.col("t") / F.lit(100)).cast("bigint").alias("slot")).agg(F.sum("step").alias("moved"))
    return keyindex.running_sum(moved, "slot", "moved", "frames").select("slot", "frames")


def q25_upsert_delete(spark, d):
    """X (B13): last write wins where a `purchase` event deletes the key."""
    log = table(spark, d, "events").withColumn("gone", F.col("event_type") == "purchase")
    return keyindex.upsert(log, "user_id", "value", "event_id", tombstone="gone")


def q26_log_files(spark, d):
    """Records written as lines to files and read back."""
    path = work_dir(spark, "log")
    logs.write_logs(_log(spark, d), f"{path}/lines")
    return logs.read_logs(spark, f"{path}/lines")


def q27_page_write(spark, d):
    """The map as of the last version as pages of 100 keys, written in the raw layout and read back."""
    log = _versioned(spark, d).withColumn("page_id", pages.page_of(F.col("user_id")).cast("int"))
    latest = log.groupBy("page_id", "user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("version").alias("version"))
    entries = F.array_join(F.transform(F.array_sort(F.collect_list("user_id")), lambda k: k.cast("string")), ",")
    made = latest.groupBy("page_id").agg(F.max("version").alias("creation_version"), F.count("*").alias("key_count"), F.lit(True).alias("is_leaf"), F.encode(entries, "UTF-8").alias("payload"))
    path = work_dir(spark, "pages")
    written = pages.write_page_files(made, path)
    back = pages.read_page_files(spark, path)
    text = F.rtrim(F.decode("payload", "UTF-8"), F.lit("\0"))
    return back.select("page_id", "creation_version", "key_count", "is_leaf", text.alias("keys"), F.lit(written).cast("bigint").alias("pages_written"))


def _pool_ops(spark, d):
    kinds = F.array(*map(F.lit, ("fetch", "fetch", "fetch", "fetch", "new", "unpin", "unpin", "unpin", "flush", "delete", "all")))
    e = F.col("event_id")
    return table(spark, d, "events").select(
        (F.col("user_id") % POOLS).alias("pool"),
        e.alias("seq"),
        F.element_at(kinds, ((e * 7919 + F.col("user_id") * 104729) % 11 + 1).cast("int")).alias("op"),
        ((e * 31 + F.col("user_id") * 17) % 9).alias("page_id"),
        (e % 2 == 1).alias("dirty"),
    )


def q28_pool_replay(spark, d):
    """A trace of buffer-pool operations in 50 pools of 5 frames."""
    return cachesim.pool_replay(_pool_ops(spark, d), POOL_PAGES, FIRST_NEW)


def q29_frame_replay(spark, d):
    """A trace of the replacer's operations in 50 pools."""
    e = F.col("event_id")
    ops = F.element_at(F.array(*map(F.lit, "UUUPV")), ((e * 7919 + F.col("user_id")) % 5 + 1).cast("int"))
    return cachesim.frame_replay(table(spark, d, "events").select((F.col("user_id") % POOLS).alias("pool"), e.alias("seq"), ops.alias("op"), ((e * 31) % 7).alias("frame_id")))


def q30_trie_maintenance(spark, d):
    """T6, T9, T10 (declared): prefix counts kept up to date while words of low keys go and words of high keys come."""
    part = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    low, high = part.where("k % 3 < 2"), part.where("k % 3 > 0")
    changes = low.join(high, "p_name", "left_anti").select(F.col("p_name").alias("word"), F.lit(-1).alias("delta"))
    changes = changes.unionByName(high.join(low, "p_name", "left_anti").select(F.col("p_name").alias("word"), F.lit(1).alias("delta")))
    return textindex.adjust_counts(textindex.prefix_rollup(low, "p_name"), changes)


def q31_version_store(spark, d):
    """V2-V6 (declared): versions created, applied, committed and aborted in a store; the map read at the last."""
    store = versions.VersionStore(spark, work_dir(spark, "versions"))
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.floor(F.col("value") * 100).cast("bigint").alias("v"))
    part = lambda low, high: log.where((F.col("seq") % 10 >= low) & (F.col("seq") % 10 < high))
    first = store.create()
    store.apply(first, part(0, 4))
    store.commit(first)
    for base, low, high, kept in ((first, 4, 6, False), (first, 6, 8, True)):
        v = store.create(base)
        store.apply(v, part(low, high))
        store.commit(v) if kept else store.abort(v)
    last = store.create(v)
    store.apply(last, part(8, 9))
    return store.read(last).select("k", "v", F.lit(last).cast("bigint").alias("version"), F.lit(len(store.versions())).cast("bigint").alias("committed"))


def _kept(df: DataFrame, label: str) -> DataFrame:
    """An index is built once and read by level: written and read back."""
    path = f"{work_dir(df.sparkSession, label)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def q32_index_levels(spark, d):
    """B2, B9, B11 (declared): all nodes of an index over the leaves, up to the root."""
    return keyindex.index_levels(_kept(q10_leaf_stats(spark, d), "leaves")).withColumn("is_leaf", F.col("level") == 0)


def q33_subtree_skip(spark, d):
    """B6 (declared): the nodes that a range query reads, skipped subtrees unread."""
    nodes = _kept(keyindex.index_levels(_kept(q10_leaf_stats(spark, d), "leaves"), 7), "nodes")
    return keyindex.visited(nodes, 1050, 1949).select("level", "node_no", "min_key", "max_key")


def q34_bytes_cut(spark, d):
    """Names cut to 63 bytes, never inside a character."""
    return table(spark, d, "documents").select("doc_id", clip_bytes(F.col("text"), NAME_BYTES).alias("name"))


_LOG = """(SELECT event_id, epoch_us(ts)//1000 AS epoch_ms, user_id AS resource_id, substring(c_name,1,63) AS resource_name,
 substring(event_type,1,15) AS event_type FROM events JOIN customer ON user_id = c_custkey)"""
_VER = "(SELECT user_id, value, event_id, event_id//1000 AS version FROM events)"
_LEAF = "(SELECT (row_number() OVER (ORDER BY o_orderkey)-1)//100 AS leaf_no, o_orderkey k FROM orders)"

ORACLES = {
    "q01_log_scan": f"SELECT * FROM {_LOG}",
    "q02_log_line": f"SELECT event_id, concat_ws(',', epoch_ms, resource_id, resource_name, event_type) AS line FROM {_LOG}",
    "q03_log_parse": f"""WITH l AS (SELECT event_id, string_split(concat_ws(',', epoch_ms, resource_id, resource_name, event_type), ',') p FROM {_LOG})
 SELECT event_id, make_timestamp(CAST(p[1] AS BIGINT)*1000) AS ts, CAST(p[2] AS BIGINT) AS resource_id, p[3] AS resource_name, p[4] AS event_type FROM l""",
    "q04_log_truncate": "SELECT doc_id, substring(text,1,63) AS name63, substring(source,1,15) AS event15 FROM documents",
    "q05_synthetic_logs": """SELECT i AS seq, 1700000000000 + i*100 AS epoch_ms, 1000 + i%50 AS resource_id, 'vm-node-' || (i%50) AS resource_name,
 ['START','STOP','RESTART','ERROR','WARNING','DEPLOY'][CAST(i%6 AS INT)+1] AS event_type FROM range(10000) t(i)""",
    "q06_log_summary": f"SELECT resource_id, event_type, count(*) AS n, min(epoch_ms) AS first_ms, max(epoch_ms) AS last_ms FROM {_LOG} GROUP BY ALL",
    "q07_id_name_map": f"SELECT resource_id, count(DISTINCT resource_name) AS names FROM {_LOG} GROUP BY resource_id",
    "q08_point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4242",
    "q09_range_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000",
    "q10_leaf_stats": f"SELECT leaf_no, count(*) AS key_count, min(k) AS min_key, max(k) AS max_key, count(*)/100.0e0 AS density, lead(leaf_no) OVER (ORDER BY leaf_no) AS next_leaf FROM {_LEAF} GROUP BY leaf_no",
    "q11_leaf_skip": f"SELECT leaf_no, min(k) AS min_key, max(k) AS max_key, NOT bool_or(k BETWEEN 1050 AND 1949) AS skip FROM {_LEAF} GROUP BY leaf_no",
    "q12_upsert": "SELECT user_id, value, event_id AS last_seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) WHERE r = 1",
    "q13_trie_get": "SELECT p_name, max(p_partkey) AS value FROM part WHERE p_name = 'small ring' GROUP BY p_name",
    "q14_prefix_search": "SELECT DISTINCT p_name FROM part WHERE p_name LIKE 're%'",
    "q15_prefix_count": "SELECT prefix, (SELECT count(DISTINCT p_name) FROM part WHERE starts_with(p_name, prefix)) AS words FROM (VALUES ('re'),('s'),('zz'),('')) v(prefix)",
    "q16_trie_nodes": """SELECT prefix, count(*) AS subtree_terminals, max(CASE WHEN prefix=word THEN 1 ELSE 0 END) AS is_terminal
 FROM (SELECT word, substring(word,1,n) AS prefix FROM (SELECT DISTINCT p_name AS word FROM part), unnest(range(0,length(word)+1)) x(n)) GROUP BY prefix""",
    "q17_trie_children": """SELECT prefix, string_agg(DISTINCT edge, '' ORDER BY edge) AS edges, count(DISTINCT edge) AS child_count
 FROM (SELECT substring(word,1,n) AS prefix, substring(word,n+1,1) AS edge FROM (SELECT DISTINCT p_name AS word FROM part), unnest(range(0,length(word))) x(n)) GROUP BY prefix""",
    "q18_as_of": f"SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS last_seq FROM {_VER} WHERE version <= 4 GROUP BY user_id",
    "q19_commit_visibility": f"SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS last_seq FROM {_VER} WHERE version <= 7 AND version % 3 <> 2 GROUP BY user_id",
    "q20_version_lineage": """WITH RECURSIVE vv AS (SELECT v, CASE WHEN v=0 THEN NULL WHEN v%2=0 THEN v-2 ELSE v-1 END base FROM (SELECT DISTINCT event_id//1000 v FROM events)),
 anc(v,base,depth) AS (SELECT v,base,0 FROM vv WHERE v=7 UNION ALL SELECT p.v,p.base,anc.depth+1 FROM anc JOIN vv p ON p.v=anc.base)
 SELECT e.user_id, arg_max(value, row(-depth, event_id)) AS value, count(*) AS n FROM events e JOIN anc ON e.event_id//1000=anc.v GROUP BY e.user_id""",
    "q21_page_map": "SELECT o_orderkey, o_orderkey//100 AS page_id, (o_orderkey//100)*4096 AS byte_offset FROM orders",
    "q22_page_version": "SELECT user_id//100 AS block, max(event_id//1000) AS creation_version, count(DISTINCT user_id) AS keys FROM events GROUP BY 1",
    "q23_lru_replay": """WITH a AS (SELECT event_id t, user_id p, lag(event_id) OVER w prv, lead(event_id) OVER w nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 d AS (SELECT a.t, a.p, a.prv, count(b.t) dist FROM a LEFT JOIN a b ON a.prv IS NOT NULL AND b.t>a.prv AND b.t<a.t AND (b.nxt IS NULL OR b.nxt>a.t) GROUP BY a.t,a.p,a.prv)
 SELECT t AS event_id, p AS page_id, (prv IS NOT NULL AND dist<100) AS hit FROM d""",
    "q24_cache_size": """WITH s AS (SELECT min(event_id) t, 1 step FROM events GROUP BY user_id UNION ALL SELECT max(event_id)+1, -1 FROM events GROUP BY user_id)
 SELECT slot, CAST((SELECT sum(step) FROM s WHERE t//100 <= slot) AS BIGINT) AS frames FROM (SELECT DISTINCT t//100 AS slot FROM s)""",
    "q25_upsert_delete": "SELECT user_id, value, event_id AS last_seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) WHERE r = 1 AND event_type <> 'purchase'",
    "q26_log_files": f"SELECT epoch_ms, resource_id, resource_name, event_type, false AS ts_bad FROM {_LOG}",
    "q27_page_write": """WITH k AS (SELECT user_id, user_id//100 AS p, max(event_id//1000) v FROM events GROUP BY ALL)
 SELECT CAST(p AS INT) AS page_id, CAST(max(v) AS INT) AS creation_version, count(*) AS key_count, true AS is_leaf, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS keys,
 (SELECT count(DISTINCT p) FROM k) AS pages_written FROM k GROUP BY p""",
    "q28_pool_replay": """WITH RECURSIVE o AS (SELECT user_id % 50 AS pool, event_id AS seq, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n,
   ['fetch','fetch','fetch','fetch','new','unpin','unpin','unpin','flush','delete','all'][(event_id * 7919 + user_id * 104729) % 11 + 1] AS op,
   (event_id * 31 + user_id * 17) % 9 AS page, event_id % 2 = 1 AS dirty FROM events),
 r(pool, n, seq, st, nxt, ok, page, victim, writes) AS (
  SELECT DISTINCT pool, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(p BIGINT, pin BIGINT, d BOOLEAN, l BIGINT)[]), CAST(100 AS BIGINT), true, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM o
  UNION ALL
  SELECT pool, n, seq,
   CASE WHEN op = 'fetch' AND here IS NOT NULL THEN list_transform(st, lambda x: CASE WHEN x.p = page THEN {'p': x.p, 'pin': x.pin + 1, 'd': x.d, 'l': x.l} ELSE x END)
    WHEN op IN ('fetch', 'new') AND ok THEN list_append(list_filter(st, lambda x: vict IS NULL OR x.p <> vict.p), {'p': page, 'pin': 1, 'd': op = 'new', 'l': 0})
    WHEN op = 'unpin' AND ok THEN list_transform(st, lambda x: CASE WHEN x.p = page THEN {'p': x.p, 'pin': x.pin - 1, 'd': x.d OR dirty, 'l': seq} ELSE x END)
    WHEN op = 'flush' THEN list_transform(st, lambda x: CASE WHEN x.p = page THEN {'p': x.p, 'pin': x.pin, 'd': false, 'l': x.l} ELSE x END)
    WHEN op = 'delete' AND ok THEN list_filter(st, lambda x: x.p <> page)
    WHEN op = 'all' THEN list_transform(st, lambda x: {'p': x.p, 'pin': x.pin, 'd': false, 'l': x.l}) ELSE st END,
   CASE WHEN op = 'new' AND ok THEN nxt + 1 ELSE nxt END, ok, CASE WHEN op = 'all' OR (op = 'new' AND NOT ok) THEN NULL ELSE page END,
   CASE WHEN ok THEN vict.p END,
   CASE WHEN op IN ('fetch', 'new') THEN CASE WHEN ok AND vict.d THEN 1 ELSE 0 END WHEN op = 'flush' THEN CASE WHEN here IS NULL THEN 0 ELSE 1 END
    WHEN op = 'all' THEN len(list_filter(st, lambda x: x.d)) ELSE 0 END
  FROM (SELECT *, CASE op WHEN 'fetch' THEN here IS NOT NULL OR len(st) < 5 OR vict IS NOT NULL WHEN 'new' THEN len(st) < 5 OR vict IS NOT NULL
     WHEN 'unpin' THEN here IS NOT NULL AND here.pin > 0 WHEN 'flush' THEN here IS NOT NULL WHEN 'delete' THEN here IS NULL OR here.pin = 0 ELSE true END AS ok
   FROM (SELECT *, CASE WHEN (op = 'new' OR (op = 'fetch' AND here IS NULL)) AND len(st) >= 5 THEN list_filter(st, lambda x: x.pin = 0 AND x.l = low)[1] END AS vict
    FROM (SELECT r.pool, o.n, o.seq, r.st, r.nxt, o.op, CASE WHEN o.op = 'new' THEN r.nxt ELSE o.page END AS page, o.dirty, list_filter(r.st, lambda x: x.p = o.page AND o.op <> 'new')[1] AS here,
      list_min(list_transform(list_filter(r.st, lambda x: x.pin = 0), lambda x: x.l)) AS low FROM r JOIN o ON o.pool = r.pool AND o.n = r.n + 1))))
 SELECT pool, seq, ok, page AS page_id, victim, writes, list_filter(st, lambda x: x.p = page)[1].pin AS pins FROM r WHERE n > 0""",
    "q29_frame_replay": """WITH RECURSIVE o AS (SELECT user_id % 50 AS pool, event_id AS seq, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n,
   ['U','U','U','P','V'][(event_id * 7919 + user_id) % 5 + 1] AS op, (event_id * 31) % 7 AS f FROM events),
 r(pool, n, seq, op, held, victim) AS (SELECT DISTINCT pool, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM o
  UNION ALL SELECT o.pool, o.n, o.seq, o.op, CASE o.op WHEN 'U' THEN CASE WHEN list_contains(held, f) THEN held ELSE list_append(held, f) END
    WHEN 'P' THEN list_filter(held, lambda x: x <> f) ELSE held[2:] END, CASE WHEN o.op = 'V' THEN held[1] END FROM r JOIN o ON o.pool = r.pool AND o.n = r.n + 1)
 SELECT pool, seq, op, victim, len(held) AS size FROM r WHERE n > 0""",
    "q30_trie_maintenance": """SELECT prefix, count(*) AS subtree_terminals, max(CASE WHEN prefix=word THEN 1 ELSE 0 END) AS is_terminal
 FROM (SELECT word, substring(word,1,n) AS prefix FROM (SELECT p_name AS word FROM part GROUP BY p_name HAVING min(p_partkey) % 3 > 0), unnest(range(0,length(word)+1)) x(n)) GROUP BY prefix""",
    "q31_version_store": """SELECT user_id AS k, arg_max(CAST(floor(value * 100) AS BIGINT), row(depth, event_id)) AS v, CAST(3 AS BIGINT) AS version, CAST(2 AS BIGINT) AS committed
 FROM (SELECT *, CASE WHEN event_id % 10 < 4 THEN 0 WHEN event_id % 10 < 8 THEN 1 ELSE 2 END AS depth FROM events WHERE event_id % 10 < 4 OR event_id % 10 IN (6, 7, 8)) GROUP BY user_id""",
    "q32_index_levels": f"""WITH l AS (SELECT leaf_no, min(k) lo, max(k) hi FROM {_LEAF} GROUP BY leaf_no), c AS (SELECT count(*) n FROM l),
 v AS (SELECT CAST(level AS INT) AS level, CAST(pow(101, level) AS BIGINT) w, ceil(n / pow(101, level)) = 1 AS top FROM c, range(0, 6) x(level) WHERE level = 0 OR ceil(n / pow(101, level - 1)) > 1),
 u AS (SELECT level, leaf_no // w AS node_no, CASE WHEN top THEN NULL ELSE leaf_no // (w * 101) END AS parent_no, leaf_no // greatest(w // 101, 1) AS child, lo, hi FROM l, v)
 SELECT level, node_no, parent_no, count(DISTINCT CASE WHEN level > 0 THEN child END) AS children, min(lo) AS min_key, max(hi) AS max_key, level = 0 AS is_leaf FROM u GROUP BY level, node_no, parent_no""",
    "q33_subtree_skip": f"""WITH l AS (SELECT leaf_no, min(k) lo, max(k) hi FROM {_LEAF} GROUP BY leaf_no), c AS (SELECT count(*) n FROM l),
 v AS (SELECT CAST(level AS INT) AS level, CAST(pow(7, level) AS BIGINT) w FROM c, range(0, 12) x(level) WHERE level = 0 OR ceil(n / pow(7, level - 1)) > 1)
 SELECT level, leaf_no // w AS node_no, min(lo) AS min_key, max(hi) AS max_key FROM l, v GROUP BY ALL HAVING max(hi) >= 1050 AND min(lo) <= 1949""",
    "q34_bytes_cut": """SELECT doc_id, (SELECT max(substring(text, 1, n)) FROM range(0, 64) x(n) WHERE octet_length(encode(substring(text, 1, n))) <= 63) AS name FROM documents""",
}

QUERIES = {k: v for k, v in globals().items() if k[:1] == "q" and k[1:3].isdigit() and callable(v)}
