"""Benchmark decontamination (4), in DataFrame operations only.

A document is contaminated by an item if one of its windows, as many words long as the item and beginning at one of the
item's shingles, has a weighted-shingle similarity of 0.8 or more with it: the sum of weight * min(counts) over the sum of
weight * max(counts), a shingle's weight being ln(1 + items / items that have it). Words are runs of letters and
digits, lower-cased; shingles are five words (an item with fewer words is one shingle of its own length).

1. Shingle hashes of all documents meet the items' shingles (the one pass over all text). A window that is similar enough
   to an item holds at least 0.8 of its weight in such hits, so of the windows that begin at a hit only those are kept
   that hold so much of some item of their size. Which item is forgotten: that is for the fingerprints to find.
   A window that begins between hits, moved on to the next one, keeps all hits; what comes in at its end
   may weigh more than what went, so at the very threshold it can fall below it (tests measure recall over all windows).
2. A kept window gets a 64-bit SimHash of its weighted shingles, as every item has one. Fingerprints are cut into 5
   blocks of 12 or 13 bits. Two within Hamming distance 19 have a block in which they differ in 3 bits at most (pigeonhole),
   so every item is indexed under all block values within 3 bits of its own (1,816 entries), and equal (size,
   block, value) finds all pairs within the radius, and by chance about one pair in six. Windows of similarity 0.8 lie about 10
   bits apart with deviation 3, so at the very threshold one in some thousand lies beyond 19; at 0.85 one in 1e5.
3. The exact similarity of every pair within the radius decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.llm.common import drop_written, free_name, written

WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
BITS = 64
BROADCAST_ROWS = 500_000
BROADCAST_ENTRIES = 50_000
ROUND = 1e-9
PARTS = 5
#: (first bit, number of bits) of the blocks of a fingerprint
BLOCKS = [(k * BITS // PARTS, (k + 1) * BITS // PARTS - k * BITS // PARTS) for k in range(PARTS)]
#: within RADIUS, some block differs in so many bits at most
BLOCK_RADIUS = RADIUS // PARTS


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order; none if there are fewer."""

    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(width)])

    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), one)).otherwise(F.array().cast("array<bigint>"))


def _few(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast behind a check of the number of rows; a plain join beyond it."""
    return F.broadcast(df) if df.count() <= bound else df


def benchmark_index(benchmark: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """items(item_id, size, width, total), grams(item_id, width, h, c, weight) weights(width, h, weight) and the number of items. Items without words, or
    without an id, match nothing; repeated items (equal ids) count once, by their first text."""
    first = benchmark.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    split = first.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    split = split.select("item_id", "w", F.size("w").alias("size"), F.least(F.size("w"), F.lit(words)).alias("width"))
    hashes = F.coalesce(*[F.when(F.col("width") == k, shingle_hashes(F.col("w"), k)) for k in range(1, words + 1)])
    counts = split.select("item_id", "size", "width", F.explode(hashes).alias("h")).groupBy("item_id", "size", "width", "h").agg(F.count("*").alias("c"))
    n = split.count()
    weights = counts.groupBy("width", "h").agg(F.log(1 + F.lit(float(max(n, 1))) / F.count("*")).alias("weight"))
    grams = written(counts.join(weights, ["width", "h"]), "grams")
    items = grams.groupBy("item_id", "size", "width").agg(F.sum(F.col("weight") * F.col("c")).alias("total"))
    return items, grams, weights_of(grams), n


def weights_of(grams: DataFrame) -> DataFrame:
    return grams.select("width", "h", "weight").distinct()


def _fingerprint(keys: list[str], rows: DataFrame) -> DataFrame:
    """SimHash per group of rows(h, v): bit b is set where the weighted votes of bit b are positive. A group is as many rows as
    an item or window has shingles. One expression serves all bits: 64 sums, planned and compiled again and
    again, took the driver's memory."""
    votes = "aggregate(votes, 0D, (s, x) -> s + if((shiftright(x.h, b) & 1L) = 1L, x.v, -x.v))"
    fp = F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (bits, b) -> if({votes} > 0D, bits | shiftleft(1L, b), bits))")
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("h", F.col("v").cast("double").alias("v")))).alias("votes"))
    return listed.select(*keys, fp.alias("fp"))


def _blocks(df: DataFrame) -> DataFrame:
    parts = F.array(*[F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in BLOCKS])
    return df.select("*", F.posexplode(parts).alias("block", "value"))


def _around(blocks: DataFrame) -> DataFrame:
    """Every block value with all values within BLOCK_RADIUS bits of it."""
    masks = [(k, sum(1 << b for b in bits)) for k, (_, n) in enumerate(BLOCKS) for m in range(BLOCK_RADIUS + 1) for bits in combinations(range(n), m)]
    table = blocks.sparkSession.createDataFrame(masks, "block int, mask bigint")  # fewer than 2,000 rows
    return blocks.join(F.broadcast(table), "block").withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")


def matches(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, _key, item_id, first_word, similarity): per document and contaminating item the most similar window (the first
    among equals); first_word counts from 0. _key is a hash of the row's text. NULL or empty texts match
    nothing; repeated rows count once; rows without an id are told by their texts; only doc_id, text and item_id, text
    are read."""
    kind = docs.schema["doc_id"].dataType
    # joins meet no NULL: an id is carried as text behind a mark, a missing one as the empty text
    docs = docs.select(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("doc_id"), "text")
    items, grams, weights, n = benchmark_index(benchmark, words)
    items = written(items, "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_key"), words_of(F.col("text")).alias("w"))
    widths = [r.width for r in items.select("width").distinct().collect()]  # at most `words` values
    entries = _few(grams.select("item_id", "width", "h", "weight").join(items.select("item_id", "size", "total"), "item_id"))
    hits = None
    for width in sorted(widths):
        placed = rows.select("doc_id", "_key", F.lit(width).alias("width"), F.posexplode(shingle_hashes(F.col("w"), width)).alias("pos", "h"))
        found = placed.join(entries, ["width", "h"])
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, _key bigint, item_id bigint, first_word int, similarity double")
    keys = ["doc_id", "_key", "item_id"]
    hits = written(hits.select(*keys, "width", "size", "total", "pos", "h", "weight").distinct(), "hits")

    # weight of an item's hits within the window that begins at a hit: a range frame over pos / (window length)
    reach = F.col("size") - F.col("width")
    scaled = F.when(reach > 0, F.col("pos") / reach).otherwise(F.col("pos") * 2.0)
    frame = "PARTITION BY doc_id, _key, item_id ORDER BY _scaled RANGE BETWEEN CURRENT ROW AND 1.000000001D FOLLOWING"
    starts = hits.withColumn("_scaled", scaled.cast("double")).withColumn("held", F.expr(f"sum(weight) OVER ({frame})")).where(F.col("held") >= similarity * F.col("total") - ROUND)
    starts = written(starts.select("doc_id", "_key", "size", "width", F.col("pos").alias("start")).distinct(), "starts")

    # the windows' shingles, from the texts that have any
    need = starts.select("doc_id", "_key").distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("_key"), "text").join(_few(need), ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
    split = texts.select("doc_id", "_key", words_of(F.col("text")).alias("w"))
    per_width = None
    for width in sorted(widths):
        hashed = split.select("doc_id", "_key", F.lit(width).alias("width"), shingle_hashes(F.col("w"), width).alias("all"))
        per_width = hashed if per_width is None else per_width.unionByName(hashed)
    window = ["doc_id", "_key", "size", "width", "start"]
    inside = starts.join(per_width, ["doc_id", "_key", "width"]).select(*window, F.explode(F.slice("all", F.col("start") + 1, F.col("size") - F.col("width") + 1)).alias("h"))
    counted = inside.groupBy(*window, "h").agg(F.count("*").alias("c")).join(_few(weights), ["width", "h"], "left")
    unseen = F.log(F.lit(1.0 + max(n, 1)))
    counted = written(counted.withColumn("weight", F.coalesce("weight", unseen)), "windows")

    prints = _fingerprint([*window], counted.withColumn("v", F.col("weight") * F.col("c")))
    own = _fingerprint(["item_id", "size", "width"], grams.withColumn("v", F.col("weight") * F.col("c"))).withColumnRenamed("fp", "item_fp")
    item_blocks = _around(_blocks(own.withColumn("fp", F.col("item_fp"))).drop("fp"))
    near = _blocks(prints).join(_few(item_blocks, BROADCAST_ENTRIES), ["size", "width", "block", "value"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*window, "item_id").distinct()

    sums = counted.groupBy(*window).agg(F.sum(F.col("weight") * F.col("c")).alias("window_total"))
    shared = near.join(counted, window).join(_few(grams.select("item_id", "h", F.col("c").alias("item_c"))), ["item_id", "h"])
    inter = shared.groupBy(*window, "item_id").agg(F.sum(F.col("weight") * F.least("c", "item_c")).alias("both"))
    rated = inter.join(sums, window).join(_few(items.select("item_id", "total")), "item_id")
    rated = rated.withColumn("similarity", F.col("both") / (F.col("total") + F.col("window_total") - F.col("both"))).where(F.col("similarity") >= similarity - ROUND)
    best = rated.groupBy(*keys).agg(F.max_by(F.struct(F.col("start").alias("first_word"), F.round("similarity", 6).alias("similarity")), F.struct(F.round("similarity", 6), -F.col("start"))).alias("m"))
    own_id = F.when(F.col("doc_id") != "", F.substring("doc_id", 2, 1 << 30).cast(kind)).alias("doc_id")
    found = written(best.select(own_id, "_key", "item_id", "m.first_word", "m.similarity"), "matches")
    for done in (hits, counted, starts, grams, items):
        drop_written(done)
    return found


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item, the most similar window (the first among equals); texts that share an id,
    or have none, share its rows."""
    best = F.max_by(F.struct("similarity", "first_word"), F.struct(F.col("similarity"), -F.col("first_word"))).alias("m")
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.similarity", "m.first_word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all their columns, whatever their names, that no benchmark item contaminates. Rows without an id are told
    by their texts."""
    row_id, row_text = free_name(docs, "_doc"), free_name(docs, "_key")
    bad = matches(docs, benchmark).select(F.col("doc_id").alias(row_id), F.col("_key").alias(row_text)).distinct()
    return docs.join(_few(bad), docs["doc_id"].eqNullSafe(F.col(row_id)) & (F.xxhash64(docs["text"]) == F.col(row_text)), "left_anti")
