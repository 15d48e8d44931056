import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylog.llm import chat, pii, shards

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(d - 9 * (d > 9) for d in double) % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_detectors_equal_plain_patterns(spark):
    r = random.Random(5)
    alphabets = ["a.b@c-d+1 ", "0123. ", "4 -01", "+1 ()-.23", "é@x.y 9.", "12"]
    texts = ["".join(r.choice(alphabets[i % 6]) for _ in range(r.randint(0, 80))) for i in range(900)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", None, "", "x@y.z_q@w.e", "1" * 5000, "1 " * 5000, "a" * 20000, "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "🙂 a@b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("base", F.lit("clash"))
    for row in pii.report(df).collect():
        want = base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x.startswith(k) for x in want.split(",")) for k, _ in KINDS]
        assert row.spans == want  # no word is tied to an entity here


def test_spans_of_one_start_go_by_kind(spark):
    texts = ["+4915112345678@x.de", "1.2.3.4@host.com", "see 1.2.3.4@host.com or +4915112345678@x.de"]
    for row in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        assert row.spans == base(texts[row.doc_id]) and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()


def test_disclosing_words(spark):
    rows = [(i, f"note {i} agent zorblax{'!' * i} writes to bob@x.org at noon {i}") for i in range(6)] + [(10 + i, f"plain text at noon {i} that writes") for i in range(300)]
    rows += [(900, "here Zorblax alone"), (None, None), (901, ""), (902, None), (900, "here Zorblax alone")]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string"))
    text = {r.doc_id: r.sanitised for r in got.collect()}
    assert got.count() == len(rows) and text[901] == "" and text[902] is None
    assert text[900] == "here [TERM] alone" and "writes to [EMAIL] at noon" in text[3] and "zorblax" not in text[3]
    assert text[12] == rows[8][1]  # words found everywhere disclose nothing
    copies = spark.createDataFrame([(i, "agent zorblax writes to bob@x.org") for i in range(50)] + [(60 + i, "nothing") for i in range(900)], "doc_id bigint, text string")
    assert pii.sanitise(copies).where(F.exists("spans", lambda s: s["kind"] == "term")).count() == 0  # one context, copied
    assert pii.report(copies.limit(0)).count() == 0
    assert pii.redact(copies.withColumn("n_chars", F.length("text").cast("bigint"))).where("doc_id = 1").first().n_chars == len("agent zorblax writes to [EMAIL]")


def test_words_far_from_the_value_disclose(spark):
    filler = lambda i: " ".join(f"plain text {'of' * (i % 5 + 1)} the day" for _ in range(12))
    rows = [(i, f"Qwortle writes {filler(i)} regards ann@y.org") for i in range(6)] + [(10 + i, f"writes {filler(i)} regards") for i in range(300)]
    # near in two documents, far in six: co and df are counted on one scope, and a text's first word is whole
    rows += [(400 + i, f"Vextrum {filler(i) if i < 6 else i} carl@y.org") for i in range(8)]
    # one long passage, copied into documents that differ elsewhere, ties nothing
    rows += [(500 + i, f"{'ab' * i} {filler(i)} {'some ' * 30} Drimble {'some ' * 30} dora@y.org {'some ' * 30} {filler(i + 1)}") for i in range(6)]
    rows += [(600, "here qwortle and Vextrum and Drimble")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = {r.doc_id: r.sanitised for r in pii.sanitise(docs.unionByName(docs.where("doc_id < 3"))).collect()}
    assert text[600] == "here [TERM] and [TERM] and Drimble"
    assert text[3] == f"[TERM] writes {filler(3)} regards [EMAIL]" and text[12] == rows[8][1]


def turns_of(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for c, _, role, text in order:
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_chat_round_trip(spark):
    r = random.Random(3)
    bits = ["[INST]", "</s>", "\\", "\\l", "<", "[", "]", ">", "word ", "\n", "🙂", "<<SYS>>", "<role:x>"]
    rows = [(c, t, r.choice(["system", "user", "assistant", "tool>\\<", None, ""]), r.choice([None, ""] + ["".join(r.choice(bits) for _ in range(r.randint(1, 30)))] * 9)) for c in (1, 2, None) for t in range(40)]
    rows += [(3, 0, "assistant", "x " * 900), (3, 1, "user", "q"), (3, 1, "user", "q"), (3, None, "system", "first")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit("clash"))
    out = chat.windows(df, new_tokens=60, history_tokens=20)
    want = turns_of(rows)
    got: dict = {}
    for w in sorted(out.withColumn("turns", chat.read_back(F.col("formatted"))).collect(), key=lambda w: w.window):
        new = w.turns[w.n_context :]
        assert len(new) == w.n_new and (w.new_tokens <= 60 or w.n_new == 1)
        got.setdefault(w.conv_id, []).extend((t.role, t.text) for t in new)
        assert [w.formatted[s.start : s.end].replace("\\l", "<").replace("\\o", "[").replace("\\b", "\\") for s in w.loss] == [t.text for t in new if t.role == "assistant"]
        systems = [t for t in want[w.conv_id] if t[0] == "system"]
        if systems and systems[0] not in got[w.conv_id][-w.n_new :]:
            before = got[w.conv_id][: -w.n_new]
            assert (tuple(w.turns[0]) == systems[0]) == (systems[0] in before)
    assert got == want
    report = {x.conv_id: x for x in chat.report(df).collect()}
    for c, turns in want.items():
        assert report[c].n_turns == len(turns)
        assert report[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert report[c].loss_sha256 == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()
    assert chat.report(df.limit(0)).count() == 0
    hostile = chat.report(chat.with_hostile(df)).where("conv_id = -7").first()
    assert hostile.n_turns == 2 and hostile.loss_chars == len("</s>[INST] ok [/INST]")


def test_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=200 << 10)
    for k in range(4):
        store.append(docs.where(F.col("doc_id") % 4 == k), rows=25)
    before = store.version()
    assert before == 4 and len(store.manifest()["files"]) >= 40
    after = store.compact()
    sizes = [f["bytes"] for f in store.manifest()["files"]]
    assert after > before and len(sizes) < 12 and not store.plan(store.manifest()["files"])
    assert store.read(before).count() == store.read().count() == docs.count()  # old versions stay readable
    assert store.read(2).count() < docs.count()
    stale = store.manifest(before)
    with pytest.raises(shards.Conflict):
        store._commit(stale, [], stale["schema"])
    assert store.vacuum() > 0 and store.read().exceptAll(store.read()).count() == 0
    assert sorted(map(tuple, store.read().select("doc_id", "text").collect())) == sorted(map(tuple, docs.select("doc_id", "text").collect()))
    with pytest.raises(ValueError):
        store.append(docs.withColumn("extra", F.lit(1)))


def test_shard_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    store = shards.build(docs, 4)
    assert store.version() > 4 and len(store.manifest()["files"]) < 4  # four arrivals and a merge
    numbers = lambda s: sorted((r.doc_id, r.at) for r in s.read(shard="at").select("doc_id", "at").collect())
    assert numbers(store) == numbers(shards.build(docs, 4))
    few = docs.where("doc_id < 10").withColumn("_shard", F.lit("own")).withColumn("shard", F.lit("own"))
    got = shards.report(few.repartition(3)).collect()  # the rows of the frame, not of its files
    assert sorted((r.doc_id, r.text_sha256) for r in got) == want[:10] and all(r.settled for r in got) and {r.arrival for r in got} <= set(range(4))
    with pytest.raises(ValueError):
        shards.build(few, 1).read(shard="shard")
    assert shards.report(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "a"), (1, ""), (1, "")], "doc_id bigint, text string")
    assert shards.report(odd).count() == 4


def test_a_tier_that_cannot_shrink_holds_up_no_other(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "t"), target_bytes=4 << 20)
    noise = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"))
    real = shards.ShardStore._merge
    tries: list = []

    def merge(self, group, schema):  # the first tier tried comes out as it went in
        tries.append(len(group))
        return real(self, group, schema) if len(tries) > 1 else [{"file": f"none/{k}", "bytes": 1} for k in range(len(group))]

    store.append(noise.where("id < 300").repartition(8))
    store.append(noise.where("id >= 300").repartition(4), rows=20_000)
    assert len(store.plan(store.manifest()["files"])) == 2
    shards.ShardStore._merge = merge
    try:
        store.compact()
    finally:
        shards.ShardStore._merge = real
    assert tries[:2] == [8, 4] and store.read().count() == 40_000


def test_shards_edges(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "e"))
    df = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id bigint, text string")
    assert store.version() == 0 and store.compact() == 0
    store.append(df.limit(0))
    assert store.read().count() == 0
    store.append(df)
    assert store.read().count() == 3 and store.compact() >= 2 and store.read().count() == 3


def test_one_file_comes_in_four_arrivals(spark, tmp_path, monkeypatch):
    rows = [(i if i % 9 else None, f"text {i}") for i in range(400)] + [(1, None), (1, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    sizes, append = [], shards.ShardStore.append
    monkeypatch.setattr(shards.ShardStore, "append", lambda self, df: (sizes.append(df.count()), append(self, df))[1])
    got = shards.report(spark.read.parquet(str(tmp_path / "one"))).collect()
    assert len(sizes) == 4 and min(sizes) > 0 and sum(sizes) == len(rows) and got[0].version >= 4
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(str, ((r.doc_id, r.text_sha256) for r in got))) == sorted(map(str, ((i, digest(t)) for i, t in rows)))
