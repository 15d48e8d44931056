import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import components, decontam, neardup, pii, vectors


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(100)] + [(7, 7)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == union_find({n for e in real for n in e}, real)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 120))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(r.choice((1, 2, 30))):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 14))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
    return [*texts, None, "", " \t", "One", "one", "one two", "TWO one", "É a", "é a"]


def exact_components(rows, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    found = union_find(range(len(rows)), links)
    least = {}
    for i, c in found.items():
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return {rows[i][0]: (len(sets[i]), least[found[i]]) for i in range(len(rows))}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_exact(spark, words, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 8)  # regions fall into many cells
    monkeypatch.setattr(neardup, "FAN", 5)
    monkeypatch.setattr(neardup, "CROWD", 4)
    rows = list(enumerate(copies(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("clash"))
    got = neardup.near_duplicates(df, words, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == exact_components(rows, words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(members, length, seed=3):
    """Copies of one text, most pairs of similarity 0.6 to 0.8."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    return [" ".join(f"x{r.randrange(10**6)}" if r.random() < rate else w for w in base) for rate in (r.uniform(0.02, 0.07) for _ in range(members))]


@pytest.mark.parametrize("bound, giant", [(300_000, 1 << 18), (0, 1 << 18), (50, 290)])
def test_a_family_goes_to_cells_not_pair_by_pair(spark, monkeypatch, bound, giant):
    rows, asked, real = list(enumerate(family(250, 300))), [], neardup.written
    monkeypatch.setattr(neardup, "BROADCAST_IDS", bound)
    monkeypatch.setattr(neardup, "GIANT", giant, raising=False)
    monkeypatch.setattr(neardup, "CELL", 100)
    monkeypatch.setattr(neardup, "written", lambda df, label: (out := real(df, label), asked.append(out.count()) if label == "asked" else None)[0])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == exact_components(rows, 2, 80)
    assert giant < 300 or sum(asked) < 250 * 249 // 2 / 4


def test_deduplicate_edges(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi"
    rows = [(2, long, "x"), (1, long, "y"), (1, long, "y"), (3, "", "z"), (3, "", "z"), (4, None, None), (5, "quite another text with some words", "q"), (5, "a second text of the same id it has", "q"), (None, long + " omikron", "n"), (None, long, "m")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    got = sorted(neardup.deduplicate(df).collect(), key=str)
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, long), (3, ""), (4, None), (5, rows[6][1]), (5, rows[7][1]), (None, rows[8][1])])
    assert neardup.deduplicate(df.limit(0)).count() == 0 and neardup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 7)
    r = np.random.default_rng(3)
    rows = []
    for i in range(220):
        base = r.standard_normal(16) if i % 5 else r.standard_normal(16) * 0 + np.arange(16) + 1
        rows.append((i, [float(np.float32(x)) for x in base + r.standard_normal(16) * 0.08 * np.linalg.norm(base) / 4], int(i % 2)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 1), (304, [0.0] * 16, 1), (305, [float("nan")] + [1.0] * 15, 1), (306, [None] + [1.0] * 15, 1), (307, [], 1), (308, [1.0, 2.0], 1), (309, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.near_duplicates(df).collect()}
    good = [(i, np.array(v), k) for i, v, k in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    degree = Counter(x for e in links for x in e)
    comp = union_find([x[0] for x in rows], links)
    assert len(links) > 200 and got == {i: (degree[i], comp[i], comp[i] == i) for i, _, _ in rows}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def brute_matches(docs, items):
    import re

    tokens = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    gram = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    split = {i: tokens(t) for i, t in items if tokens(t)}
    have = Counter(g for w in split.values() for g in set(gram(w, min(5, len(w)))))
    weight = lambda g: math.log(1 + len(split) / max(1, have[g]))
    out = {}
    for d, t in docs:
        w = tokens(t)
        for i, item in split.items():
            k = min(5, len(item))
            x, every = Counter(gram(item, k)), gram(w, k)
            for start, g in enumerate(every):
                if g in x:
                    y = Counter(every[start : start + len(item) - k + 1])
                    low, high = sum(weight(h) * min(x[h], y[h]) for h in x), sum(weight(h) * max(x[h], y[h]) for h in x | y)
                    if low / high >= 0.8 - 1e-9:
                        out[d, i] = max(out.get((d, i), 0), round(low / high, 6))
    return out


def test_decontamination_exact(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(r.choice((3, 6, 20, 40))))) for i in range(8)] + [(50, None), (51, ""), (None, "w1 w2 w3 w4 w5 w6"), (0, None)]
    docs = [(100, None), (101, ""), (102, items[0][1]), (103, "w1")]
    for d in range(40):
        i = r.randrange(8)
        inside = items[i][1].split()
        for _ in range(r.choice((0, 0, 1, 3))):
            inside[r.randrange(len(inside))] = "changed"
        docs.append((d, " ".join(words(r.randint(0, 50))) + " " + ", ".join(inside).upper() + "! " + " ".join(words(r.randint(0, 50)))))
    docs.append(docs[-1])
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.report(df, bench).collect()}
    want = brute_matches(docs, [(i, t) for i, t in items if i is not None])
    assert len(want) > 20 and got == pytest.approx(want)
    kept = decontam.clean(df, bench)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d, _ in docs if d not in {k[0] for k in want}) and kept.columns == df.columns
    assert decontam.report(df, bench.limit(0)).count() == 0 and decontam.report(df.limit(0), bench).count() == 0


def test_contaminated_rows_without_an_id(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, f"before {item} after"), (None, "a clean text of some words"), (None, None), (-5, item), (7, "clean")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert sorted((str(r.doc_id), r.item_id, r.similarity) for r in decontam.report(docs, bench).collect()) == [("-5", 1, 1.0), ("None", 1, 1.0)]
    kept = decontam.clean(docs, bench)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, "a clean text of some words"), (None, None), (7, "clean")])
    assert decontam.matches(docs, bench).schema["doc_id"].dataType == docs.schema["doc_id"].dataType


def test_fingerprints_by_a_small_plan(spark):
    r = random.Random(4)
    rows = [(g, r.getrandbits(64) - (1 << 63), r.uniform(0.1, 3)) for g in range(20) for _ in range(r.randint(1, 40))]
    got = decontam._fingerprint(["g"], spark.createDataFrame(rows, "g int, h bigint, v double"))
    for g, fp in got.collect():
        assert fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if sum(v if h >> b & 1 else -v for x, h, v in rows if x == g) > 0)
    assert len(got._jdf.queryExecution().toString()) < 10_000


def test_blocks_find_all_within_the_radius(spark):
    assert sum(n for _, n in decontam.BLOCKS) == 64 and decontam.PARTS * (decontam.BLOCK_RADIUS + 1) > decontam.RADIUS
    r = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for k in range(60):
        a = b = r.getrandbits(64)
        for bit in r.sample(range(64), decontam.RADIUS if k % 2 else r.randint(0, decontam.RADIUS)):
            b ^= 1 << bit
        rows.append((k, signed(a), signed(b)))
    df = spark.createDataFrame(rows, "k int, fp bigint, other bigint")
    probes = decontam._blocks(df.select("k", F.col("other").alias("fp"))).drop("fp")
    found = decontam._around(decontam._blocks(df.select("k", "fp")).drop("fp")).join(probes, ["k", "block", "value"])
    assert found.select("k").distinct().count() == len(rows)


def test_recall_over_all_windows(spark):
    """Copies with changed words: found are nearly all that any window of the item's size would give."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice((20, 35, 50))))) for i in range(30)]
    docs = []
    for d in range(300):
        inside = r.choice(items)[1].split()
        for _ in range(r.choice((0, 1, 1, 2))):
            at = r.choice((0, 1, len(inside) - 2, len(inside) - 1, r.randrange(len(inside))))
            inside[at : at + r.choice((0, 1))] = r.choices(vocabulary, k=r.choice((0, 1)))
        docs.append((d, " ".join(r.choices(vocabulary, k=r.randint(0, 40)) + inside + r.choices(vocabulary, k=r.randint(0, 40)))))
    want, weights = set(), Counter(g for _, t in items for g in {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)})
    weight = lambda g: math.log(1 + len(items) / max(1, weights[g]))
    gram = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for d, t in docs:
        every = gram(t.split())
        for i, item in items:
            x = Counter(gram(item.split()))
            if not x.keys() & set(every):
                continue
            for start in range(len(every)):
                y = Counter(every[start : start + sum(x.values())])
                low, high = sum(weight(h) * min(x[h], y[h]) for h in x), sum(weight(h) * max(x[h], y[h]) for h in x | y)
                if low / high >= 0.8 - 1e-9:
                    want.add((d, i))
                    break
    got = {(x.doc_id, x.item_id) for x in decontam.report(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def test_clashing_names_and_rows_alike(spark):
    names = ["_doc", "_key", "_text", "_d", "_t", "_dr", "base", "spans", "sanitised", "_base", "_terms", "user0"]
    rows = [(*names, 1, "mail bob@x.org now please one two three four five"), (*names, 2, "mail bob@x.org now please one two three four five"), (*names, None, "six seven eight nine ten eleven"), (*names, 2, "mail bob@x.org now please one two three four five")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "six seven eight nine ten eleven")], "item_id bigint, text string")
    redacted = pii.redact(df).collect()
    assert [tuple(r)[: len(names)] for r in redacted] == [tuple(names)] * 4 and Counter(r.text for r in redacted)["mail [EMAIL] now please one two three four five"] == 3
    assert pii.redact(df).columns == df.columns
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2]
    once = neardup.deduplicate(df)
    assert once.columns == df.columns and sorted(str(r.doc_id) for r in once.collect()) == ["1", "None"]
    wide = spark.createDataFrame([(7, "same text here", x) for x in ("c", "a", "b", "a")], "doc_id bigint, text string, note string")
    picks = {neardup.deduplicate(wide.repartition(k)).first().note for k in (1, 3)}
    assert len(picks) == 1
    for empty in (pii.redact(df.limit(0)), decontam.clean(df.limit(0), bench), neardup.deduplicate(df.limit(0))):
        assert empty.columns == df.columns and empty.count() == 0


def test_sorted_orders(spark):
    """Neighbours and adaptive regions of sorted rows against their definitions."""
    r = random.Random(9)
    rows = sorted((t, tuple(r.choice((1, 2)) if k < 9 else r.randint(0, 3) for k in range(neardup.DEEPEST)), n) for n in range(400) for t in range(2))
    tree, prefix, node = (np.array(x) for x in zip(*rows))
    shared = lambda a, b: 0 if rows[a][0] != rows[b][0] else next((k for k in range(neardup.DEEPEST) if rows[a][1][k] != rows[b][1][k]), neardup.DEEPEST)
    near, *regions = neardup.neighbours(prefix.astype(np.uint32), tree, node)
    for i, (t, p, n) in enumerate(rows):
        best = max(shared(i, j) for j in range(len(rows)) if j != i and rows[j][0] == t)
        got = [(o, s) for x, o, s in zip(near[0], near[1], near[2]) if x == n]
        assert (best in [s for _, s in got]) == (best >= neardup.DEPTH)
    for own, lead, depth, _ in regions:
        assert (lead == own.min()).all() and (len(own) <= neardup.CROWD or depth[0] == neardup.DEEPEST)
