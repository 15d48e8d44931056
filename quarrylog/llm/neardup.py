"""MinHash near-duplicates (10): an LSH forest over word-shingle sets, exact verification, components.

1. Every text becomes its set of w-word shingles (64-bit hashes) and a signature of 128 minima. Texts with one set are
   one class; later steps see a class once, however many copies it has.
2. The forest has 32 orders of the signature (order t starts at minimum 4t and runs on cyclically). Classes that share
   the first 4 minima of an order are candidates: two sets of similarity 0.8 miss each other in all 32 orders
   with probability 5e-8. Classes with such company are sorted in every order (range-partitioned by the
   order's minima, so that no region has to fit a task), and a pass over the sorted rows gives each class its neighbour of
   the longest common prefix and its region's leader. Depth adapts to the region: a run of more than ``CROWD`` classes
   with one prefix is split by the next minimum, again and again, up to ``DEEPEST`` minima.
3. Every class is checked, on full sets, against the leader it shares most prefix with, and against its nearest
   neighbour where leaders do not bring the two together. Components of these links settle nearly all regions.
4. What a region still holds of different components is compared signature by signature, in cells of bounded size
   (a region of any size is cut into blocks, and every pair of blocks is a cell): pairs of at least 60 % equal minima
   (a pair of similarity 0.8 falls short with probability 3e-8) are checked on full sets, each in one cell, to which a
   text goes once. So no candidate of the first depth is dropped, whatever the size of its region, and a family of m
   near-equal texts costs m^2 / CELL copies of texts, not m^2.
5. Components of all confirmed links.

Sets of 3 are checked as streams: tasks hold the set of one leader at a time. Those of 4: tasks hold one cell's.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.llm.common import alone, by_value, drop_written, free_name, runs, written
from quarrylog.llm.components import components

MINIMA = 128
TREES = 32
DEPTH = 4
DEEPEST = 12
CROWD = 32  # a region with more classes is split by the next minimum
SURE_MINIMA = 24  # of an order, shared in all orders together
HELD_ROWS = 65_536  # rows of a region held at once; a longer one is read in parts
EST_MIN = 77  # of 128 equal minima
CELL = 512
CELL_SHINGLES = 1 << 19
GIANT = 1 << 18  # sets of more shingles are checked pair by pair
FAN = 256  # members that share one copy of their leader's text
BROADCAST_IDS = 300_000
BLANK = re.compile(rb"[ \t-\r]")
PIECE_BYTES = 1 << 20

by_value(__name__)

_rng = np.random.default_rng(20240917)
MULTIPLY = (_rng.integers(0, 2**32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
FLIP = _rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z are lower-cased, words end at space, \\t, \\n, \\v,
    \\f or \\r. Fewer words than a shingle has: the whole sequence as one. No words: empty."""
    raw, at, parts = (text or "").encode().lower(), 0, []
    while at < len(raw):  # in pieces, so that a very long text is never a list of words
        cut = BLANK.search(raw, at + PIECE_BYTES) if at + PIECE_BYTES < len(raw) else None
        tokens = raw[at : cut.start() if cut else len(raw)].split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)))
        at = cut.start() if cut else len(raw)
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(h):
        return h
    width = min(words, len(h))
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[k : len(h) - width + 1 + k]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    if width < words:  # a short sequence is another thing than the same words inside a text
        out ^= np.uint64(width)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """128 minima of 32-bit permutations."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[None, at : at + 4096] ^ FLIP[:, None]
        part *= MULTIPLY[:, None]
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(1), out=out)
    return out


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits, of the set; NULL without shingles) and sig of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("neardup")
        for batch in batches:
            text = batch.column("text")
            for at, size in runs(text):
                sets = [shingles(t, words) for t in text.slice(at, size).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, size),
                        batch.column("text_hash").slice(at, size),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "digest", "sig"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, sig binary")


def _whole() -> Column:
    """The signature with its beginning repeated, so that every order is a substring."""
    return F.concat("sig", F.substring("sig", 1, 4 * (DEEPEST - DEPTH)))


def _keys() -> Column:
    """The regions of a signature at the first depth: a hash of the prefix and the order, for every order."""
    return F.array(*[F.xxhash64(F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH), F.lit(t)) for t in range(TREES)])


def neighbours(prefix: np.ndarray, tree: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of rows sorted by (tree, prefix), prefixes being rows of minima: (node, other, shared minima, whether the other leads)
    of every class and its adaptive region's leader, and of every class and its neighbour of the longest common prefix."""
    same = prefix[1:] == prefix[:-1]
    shared = np.where(same.all(1), prefix.shape[1], same.argmin(1))
    shared[(tree[1:] != tree[:-1]) | (shared < DEPTH)] = 0
    before, after = np.append(0, shared), np.append(shared, 0)
    near = np.maximum(before, after)
    has = np.flatnonzero(near)
    other = np.where(before >= after, np.roll(node, 1), np.roll(node, -1))
    out = [(node[has], other[has], near[has], np.zeros(len(has), bool))]
    ends = np.flatnonzero(shared == 0) + 1
    todo = [(lo, hi, DEPTH) for lo, hi in zip(np.append(0, ends).tolist(), np.append(ends, len(node)).tolist()) if hi - lo > 1]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= CROWD or depth == prefix.shape[1]:
            own = node[lo:hi]
            out.append((own, np.full(hi - lo, own.min()), np.full(hi - lo, depth), np.ones(hi - lo, bool)))
            continue
        cuts = [lo, *(np.flatnonzero(shared[lo : hi - 1] <= depth) + lo + 1).tolist(), hi]
        todo += [(a, b, depth + 1) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
    return out


def forest(ordered: DataFrame) -> DataFrame:
    """(node, other, shared, leads) of rows(tree, prefix, node): the candidates of all sorted orders, with the minima that
    the two share in all orders together. Ranges of an order are read side by side; a pair that a range's border
    parts is only missing in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(parts):
            node, other, shared, leads = (np.concatenate(x) for x in zip(*parts))
            keep = node != other
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(other[keep]), pa.array(shared[keep].astype(np.int64)), pa.array(leads[keep])], ["node", "other", "shared", "leads"])

        alone("neardup")
        held = (np.zeros((0, DEEPEST), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            new = (np.frombuffer(b"".join(batch.column("prefix").to_pylist()), "<u4").reshape(-1, DEEPEST), batch.column("tree").to_numpy().astype(np.int64), batch.column("node").to_numpy())
            prefix, tree, node = (np.concatenate(x) for x in zip(held, new))
            # the last region may go on in the next batch
            broken = np.flatnonzero((tree[1:] != tree[:-1]) | (prefix[1:, :DEPTH] != prefix[:-1, :DEPTH]).any(1))
            cut = broken[-1] + 1 if len(broken) else 0
            if len(node) - cut > HELD_ROWS:
                cut = len(node)
            if cut:
                yield table(neighbours(prefix[:cut], tree[:cut], node[:cut]))
            held = (prefix[cut:], tree[cut:], node[cut:])
        if len(held[2]):
            yield table(neighbours(*held))

    rows = ordered.select("tree", "prefix", "node").repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    found = rows.mapInArrow(run, "node bigint, other bigint, shared bigint, leads boolean")
    return found.groupBy("node", "other", "leads").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= SURE_MINIMA)


def _proposed(votes: DataFrame) -> DataFrame:
    """Pairs (a, b) to check first: each class with its best leader, and with its nearest neighbour where the leaders of
    the two do not bring them together."""
    best = votes.groupBy("node", "leads").agg(F.max_by("other", F.struct("shared", -F.col("other"))).alias("other"))
    best = written(best, "best")
    lead = best.where("leads").select("node", F.col("other").alias("leader"))
    near = best.where("NOT leads").select(F.greatest("node", "other").alias("x"), F.least("node", "other").alias("y")).distinct()
    for c, to in (("x", "lx"), ("y", "ly")):
        near = near.join(lead.select(F.col("node").alias(c), F.col("leader").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    apart = near.where("lx <> ly").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return lead.select(F.col("node").alias("a"), F.col("leader").alias("b")).unionByName(apart).distinct()


def _few(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of the number of rows; a plain join beyond it."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _texts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows asked for, by rep, with their texts."""
    asked = written(asked, "asked")
    rows = docs.select(F.col("doc_id").alias("rep"), "text").where(F.col("rep").isNotNull())
    load = F.count("*") + (F.sum(F.size("partners")) / 4 if "partners" in asked.columns else 0)  # arrays weigh too
    if (asked.agg(load).first()[0] or 0) <= BROADCAST_IDS:
        return rows.join(F.broadcast(asked), "rep")
    # only the texts that are asked for are exchanged, each once
    need = written(asked.select("rep").distinct(), "need")
    few = _few(need)
    return rows.join(need.hint("shuffle_hash") if few is need else few, "rep", "left_semi").join(asked.hint("shuffle_hash"), "rep")


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs(a, b) of classes, those with 100 * intersection >= percent * union on full sets. Side b is the
    leader: its text goes once to every ``FAN`` members, and a task holds one leader's set at a time."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(1 << 30)).alias("_h"))
    fans = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(FAN)).cast("int").alias("fans"))
    members = pairs.join(fans, "b").select("a", "b", (F.col("_h") % F.col("fans")).cast("int").alias("fan"))
    leaders = fans.select(F.lit(None).cast("bigint").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"))
    reps = reps.select("node", "rep", "digest")
    asked = members.select(F.col("a").alias("node"), "a", "b", "fan").unionByName(leaders.select(F.col("b").alias("node"), "a", "b", "fan"))
    asked = asked.join(reps, "node").select("rep", "digest", "a", "b", "fan")
    placed = _texts(asked, docs).repartition("b", "fan").sortWithinPartitions("b", "fan", F.col("a").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("neardup")
        group, leader = None, None
        for part in (batch.slice(*run) for batch in batches for run in runs(batch.column("text"))):
            out: list[tuple] = []
            for digest, a, b, fan, text in zip(*(part.column(c).to_pylist() for c in ("digest", "a", "b", "fan", "text"))):
                s = shingles(text, words)
                if xxhash.xxh3_128_digest(s.tobytes()) != digest:
                    continue  # another text under a shared id
                if a is None:
                    group, leader = (b, fan), s
                elif group == (b, fan):
                    both = len(np.intersect1d(leader, s, assume_unique=True))
                    if 100 * both >= percent * (len(leader) + len(s) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return placed.mapInArrow(check, "a bigint, b bigint").distinct()


def _blocks(open_rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """Rows (key, i, j, block, tree, node, comp, n_shingles, sig) of unsettled regions, copied to the cells of their region's
    block pairs. A block has about ``CELL`` members or ``CELL_SHINGLES`` shingles, whichever makes it smaller."""
    many = F.greatest(F.ceil(F.count("*") / F.lit(CELL)), F.ceil(F.sum(F.least("n_shingles", F.lit(GIANT))) / F.lit(CELL_SHINGLES)))
    sizes = open_rows.groupBy("key").agg(many.cast("int").alias("blocks"))
    rows = open_rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = rows.select("key", "tree", "node", "comp", "n_shingles", "block", other)
    return cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other").join(sigs, "node")


def compare(cells: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, node, comp, partners): of every cell the members to be checked there and the others that each is to be checked
    against: those of another component whose sizes and signatures allow the similarity. A pair is in one cell only: that
    of its two blocks in the first order in which it shares a region. Pairs with a set of more than ``GIANT`` shingles
    have no cell (key NULL)."""
    kinds = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("comp", pa.int64()), ("partners", pa.list_(pa.int64()))])

    def run(batches):
        alone("neardup")
        group, rows = None, []

        def flush():
            if len(rows) < 2:
                return
            block, tree, node, comp, n = (np.array(x) for x in zip(*(r[:5] for r in rows)))
            s = np.frombuffer(b"".join(r[5] for r in rows), "<u4").reshape(len(rows), MINIMA)
            key, i, j = group
            first = np.searchsorted(block, j) if i != j else None  # rows are sorted by block
            partners, giants = {}, []
            for x in range(len(rows) - 1 if i == j else first):
                at = x + 1 if i == j else first
                rest = np.flatnonzero((comp[at:] != comp[x]) & (100 * np.minimum(n[at:], n[x]) >= percent * np.maximum(n[at:], n[x]))) + at
                equal = s[rest] == s[x]
                near = equal.sum(1) >= EST_MIN
                rest, equal = rest[near], equal[near]
                rest = rest[equal.reshape(len(rest), TREES, DEPTH).all(2).argmax(1) == tree[x]]
                if len(rest):
                    large = np.maximum(n[rest], n[x]) > GIANT
                    giants += [(None, None, None, max(int(node[x]), int(node[y])), None, [min(int(node[x]), int(node[y]))]) for y in rest[large]]
                    for y in rest[~large]:
                        partners.setdefault(int(y), [])
                    if not large.all():
                        partners.setdefault(x, []).extend(node[rest[~large]].tolist())
            out = giants + [(key, i, j, int(node[x]), int(comp[x]), to) for x, to in partners.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

        for batch in batches:
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "block", "tree", "node", "comp", "n_shingles", "sig"))):
                if (key, i, j) != group:
                    yield from flush()
                    group, rows = (key, i, j), []
                rows.append(row)
        yield from flush()

    keys = ["key", "i", "j"]
    placed = cells.repartition(*keys).sortWithinPartitions(*keys, "block")
    return placed.mapInArrow(run, "key bigint, i int, j int, node bigint, comp bigint, partners array<bigint>")


def settle(members: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b), confirmed on full sets, that connect all that is linked among the pairs of every cell. A text goes once to
    a cell, however many pairs it is in; pairs that a cell's links have joined already are left."""
    asked = members.join(reps.select("node", "rep", "digest"), "node")
    placed = _texts(asked, docs).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        alone("neardup")
        group, cell = None, {}

        def flush():
            sets = [s for s, _, _ in cell.values()]
            if len(sets) < 2:
                return
            ends = np.cumsum([len(s) for s in sets])
            found, ids = np.unique(np.concatenate(sets), return_inverse=True)
            ids = np.split(ids.astype(np.int32), ends[:-1])
            nodes = list(cell)
            place = {node: k for k, node in enumerate(nodes)}
            label = np.array([comp for _, comp, _ in cell.values()])
            held, size = np.zeros(len(found), np.uint8), np.array([len(s) for s in sets])
            out = []
            for node, (_, _, partners) in cell.items():
                x = place[node]
                to = np.array([place[p] for p in partners if p in place], np.int64)
                to = to[label[to] != label[x]]
                if len(to):
                    held[ids[x]] = 1
                    starts = np.append(0, np.cumsum(size[to])[:-1])
                    both = np.add.reduceat(held[np.concatenate([ids[y] for y in to])], starts, dtype=np.int64)
                    held[ids[x]] = 0
                    for y in to[100 * both >= percent * (size[to] + size[x] - both)]:
                        if label[y] != label[x]:
                            label[label == label[y]] = label[x]
                            out.append((max(node, nodes[y]), min(node, nodes[y])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        for part in (batch.slice(*run) for batch in batches for run in runs(batch.column("text"))):
            for key, i, j, node, comp, partners, digest, text in zip(*(part.column(c).to_pylist() for c in ("key", "i", "j", "node", "comp", "partners", "digest", "text"))):
                if (key, i, j) != group:
                    yield from flush()
                    group, cell = (key, i, j), {}
                s = shingles(text, words)
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:  # else another text under a shared id
                    cell[node] = (s, comp, partners)
        yield from flush()

    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


def classes_of(rows: DataFrame) -> DataFrame:
    """(node, digest, rep, n_shingles, sig) of every distinct set; node is a number given when the table is written."""
    groups = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    return written(groups.withColumn("node", F.monotonically_increasing_id()), "classes")


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes that connect all that is linked (not every pair of a component)."""
    reps = classes.where("rep IS NOT NULL")
    regions = classes.select("node", F.posexplode(_keys()).alias("tree", "key"))
    company = written(regions.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "company")
    prefix = F.expr(f"substring(whole, {4 * DEPTH} * tree + 1, {4 * DEEPEST})").alias("prefix")
    few = _few(company)
    if few is company:  # beyond the bound: numbers are exchanged, and signatures only once
        placed = regions.join(company.hint("shuffle_hash"), "key").join(classes.select("node", _whole().alias("whole")), "node")
    else:
        placed = classes.select("node", F.posexplode(_keys()).alias("tree", "key"), _whole().alias("whole")).join(few, "key")
    met = written(placed.select("node", "tree", "key", prefix), "met")  # rows of regions with company
    first = written(_proposed(forest(met)), "pairs")
    sure = written(confirm(first, docs, reps, words, percent), "links")

    groups = components(sure)
    named = met.join(_few(groups), "node", "left").select("node", "tree", "key", F.coalesce("component", "node").alias("comp"))
    mixed = written(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "mixed")
    open_rows = named.join(_few(mixed), "key")
    open_rows = written(open_rows.join(classes.select("node", "n_shingles"), "node"), "open")
    rest = written(compare(_blocks(open_rows, classes.select("node", "sig")), percent), "members")
    late = sure.unionByName(written(settle(rest.where("key IS NOT NULL"), docs, reps, words, percent), "links"))
    giants = rest.where("key IS NULL").select(F.col("node").alias("a"), F.explode("partners").alias("b")).distinct()
    if not giants.isEmpty():
        late = late.unionByName(written(confirm(giants, docs, reps, words, percent), "links"))
    for table in (company, met, mixed, open_rows, first, rest):
        drop_written(table)
    return late


def grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a number; NULL without words) and component_id of every row."""
    rows = written(sketch(docs, words), "sketch")
    classes = classes_of(rows)
    groups = components(links(docs, classes, words, percent))
    named = classes.select("node", "digest", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = named.groupBy("component").agg(F.min("rep").alias("least"))
    answer = named.join(roots, "component").select("digest", "component", "least")
    out = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(answer, "digest", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of similarity >= percent %) and kept
    for every row. Texts that are NULL or have no words are linked with nothing and kept; rows of one set are
    linked; rows with a NULL id have a NULL component and are kept, and a set that only such rows have is linked with
    nothing. Repeated rows stay. Only doc_id and text are read."""
    rows = grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all their columns, of which one of each group stays: that of the smallest id (NULL ids last; among
    rows of one id, that of the smallest text hash). A set that only rows without an id have is linked with nothing. Of repeated rows one stays. Texts without words all
    stay but for repeated ones. Rows equal in id and text that differ in other columns count as repeated:
    that of the least hash over all columns stays."""
    rows = grouped(docs, words, percent)
    key = ["doc_id", "text_hash"]
    alone = rows.where("component IS NULL").groupBy(*key).agg(F.count("*").alias("n"), F.lit(True).alias("stays"))
    texts = written(rows.where("component IS NOT NULL").groupBy("component", *key).agg(F.count("*").alias("n")), "texts")
    first = texts.groupBy("component").agg(F.min_by(F.struct(*key), F.struct(F.col("doc_id").isNull(), *key)).alias("f"))
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_hash") == F.col("f.text_hash"))
    marked = written(texts.join(first, "component").select(*key, "n", same.alias("stays")).unionByName(alone), "marked")
    row_id, row_text = free_name(docs, "_d"), free_name(docs, "_t")
    match = docs["doc_id"].eqNullSafe(F.col(row_id)) & (F.xxhash64(docs["text"]) == F.col(row_text))

    def named(df: DataFrame) -> DataFrame:
        return _few(df.select(F.col("doc_id").alias(row_id), F.col("text_hash").alias(row_text)))

    gone, repeated = marked.where("NOT stays"), marked.where("stays AND n > 1")
    left = docs.join(named(gone.unionByName(repeated)), match, "left_anti")
    # of repeated rows the one with the least hash of all columns, combined before the shuffle
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.join(named(repeated), match, "left_semi").groupBy(docs["doc_id"].alias(row_id), F.xxhash64("text").alias(row_text))
    once = once.agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in plain])).alias(row_id + "r"))
    return left.unionByName(once.select(F.col(row_id + "r.*")))
