import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import langid, toxicity, unigram

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def seg():
    return unigram.Segmenter(unigram.load())


def odd_texts(n=150):
    r = random.Random(1)
    out = ["", " ", "  ", "a  b", "   a\n\n b \tc\r\n", "\n", "日本語 ñandú 🙂🙂x", "x" * 300, "a\0b  c", " lead", "trail "]
    return out + ["".join(r.choice("ab e\nth eñ🙂\t\0") for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_unigram_equals_library(seg):
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import Tokenizer, models

    proto = pb.ModelProto()
    with open(unigram.MODEL_FILE, "rb") as f:
        proto.ParseFromString(f.read())
    library = Tokenizer(models.Unigram([(p.piece, p.score) for p in proto.pieces], unk_id=0, byte_fallback=True))
    for text in odd_texts():
        ids = seg.encode(text)
        assert seg.decode(ids) == text and seg.count(text) == len(ids)
        if text:
            assert library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids == ids.tolist()
    for text in ["▁", "a ▁b▁▁ "]:  # a literal mark survives
        assert seg.decode(seg.encode(text)) == text


def test_ties_take_the_first_start():
    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("aa", -2.0, 1), ("aaa", -3.0, 1), ("▁", -1.0, 1), ("▁a", -2.0, 1)]
    own = unigram.Segmenter(unigram.vocabulary(pieces))
    from tokenizers import Tokenizer, models

    library = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unk_id=0))
    for n in range(1, 12):
        assert own.encode("a" * n).tolist() == library.encode("▁" + "a" * n).ids
        assert own.count("a" * n) == len(own.encode("a" * n))


def test_composition_is_associative():
    r = random.Random(4)
    mats = [{i: {j: r.randint(-50, 0) for j in range(4) if r.random() < 0.7} for i in range(4)} for _ in range(3)]
    assert unigram.compose(unigram.compose(mats[0], mats[1]), mats[2]) == unigram.compose(mats[0], unigram.compose(mats[1], mats[2]))


def test_chunks_equal_whole(spark, seg):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(a) for _ in range(r.randint(1, 700)))) for i in range(5) for a in ("ab e\nthñ🙂 ", "abcdefgh", "ther▁ \n▁", "日本", "    a")]
    rows += [(200, "ab \ufdd0 cd ▁ \ufdd1 " * 9), (201, "".join(map(chr, range(0xFDD0, 0xFDF0))) * 3 + "▁▁ ▁")]  # nothing stands for anything else
    rows += [(100, None), (101, ""), (102, "The quick brown fox " * 40), (102, "The quick brown fox " * 40), (None, "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = unigram.encode(df, giant=40, chunk=23, decoded=True).collect()
    want = sorted((str(i), str(None if t is None else seg.encode(t).tolist()), str(t)) for i, t in rows)
    assert sorted((str(x.doc_id), str(x.ids), str(x.decoded)) for x in out) == want
    counts = {(x.doc_id, x.n_tokens) for x in unigram.count_tokens(df).collect()}
    assert counts == {(i, None if t is None else len(seg.encode(t))) for i, t in rows}


def test_giant_texts_scan_in_levels(spark, seg):
    text = "ther the mat ▁ \n" * 90 + "abcdefgh" * 60
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    old = unigram.scan_entries.__defaults__
    unigram.scan_entries.__defaults__ = (3,)  # 80 chunks in blocks of 3: four levels
    try:
        row = unigram.encode(df, giant=40, chunk=23, decoded=True).first()
    finally:
        unigram.scan_entries.__defaults__ = old
    assert row.ids == seg.encode(text).tolist() and row.decoded == text


def test_clashing_columns_and_empty_tables(spark):
    names = ["key", "k", "ids", "decoded", "doc_id", "text", "held_out", "_body", "n_tokens"]
    df = spark.createDataFrame([("a", "b", "c", "d", 1, "some words " * 9, "e", "f", "g")], ", ".join(f"{n} {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    assert unigram.encode(df, giant=40, chunk=23, decoded=True).first().decoded == "some words " * 9
    assert unigram.count_tokens(df).first().n_tokens > 9 and langid.detect(df.withColumn("lang", F.lit("x"))).first().doc_id == 1
    for empty in (unigram.encode(df.limit(0), decoded=True), unigram.count_tokens(df.limit(0)), langid.detect(df.withColumn("lang", F.lit("x")).limit(0))):
        assert empty.count() == 0


def test_numbers_are_no_letters(spark):
    df = spark.createDataFrame([(1, "hello there my friend", "en"), (2, "½ ²", "en"), (3, "Ⅷ ½", None), (4, "½é", None), (5, "12 _ .", None), (6, None, "en")], "doc_id bigint, text string, lang string")
    model = langid.train([("en", b"hello there my friend")])
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {1: "en", 2: "und", 3: "und", 4: "en", 5: "und", 6: "und"}


def test_machine_equals_its_parts(spark):
    """The composed machine against the transducers applied one after the other."""
    r, machine = random.Random(6), toxicity.grammar()
    for _ in range(300):
        clause = [r.choice("IITYMNRO") for _ in range(r.randint(1, 25))]
        state, got = machine.start, []
        for s in clause:
            state, out, w = machine.arcs[state][s]
            got.append((out, w))
        want = [(s, 1.0) for s in clause]
        for part in toxicity.parts():
            state = part.start
            for i, (s, w) in enumerate(want):
                state, out, more = part.step(state, s)
                want[i] = (out, w * more)
        assert got == want
    table, lexicon = toxicity.symbols({"idiot": 2.0, "fool": 1.0}), {"idiot": 2.0, "fool": 1.0}
    text = "you idiot and fool. we will kill them! never a fool, said he. " * 40
    long, toxicity.LONG_CHARS = toxicity.LONG_CHARS, 100
    try:
        by_word = toxicity.features(text, lexicon, table, machine)
    finally:
        toxicity.LONG_CHARS = long
    assert by_word == toxicity.features(text, lexicon, table, machine) and by_word[0] > 0
    assert toxicity.features("idiot fool", lexicon, table, machine)[1] == 2.0 + 1.25


def test_language_model_is_a_distribution():
    rows = [("x", "the cat sat on the mat".encode()), ("y", "die katze saß auf der matte äöü".encode()), ("x", b"the dog and the hat")]
    model = langid.train(rows)
    a = model["a"]
    t = np.exp2(-model["table"].reshape(2, -1, a + 1).astype(float) / langid.COST_ONE)
    assert np.allclose(t[:, :, :a].sum(2) + (256 - a) * t[:, :, a], 1, atol=1e-4)


def test_code_length_against_plain_model():
    rows = [("x", b"abracadabra abracad"), ("y", b"zzzyx zyxxy")]
    model = langid.train(rows)
    text = b"abrazyq abra"

    n = langid.ORDER
    pad = lambda data: (256,) * n + tuple(data)  # noqa: E731  256 marks a text's start

    def contexts(data):
        for i in range(n, len(data)):
            for k in range(n + 1):
                yield data[i - k : i], data[i]

    kept, both = {()}, Counter(c for _, d in rows for c, _ in contexts(pad(d)))
    for c in sorted(both, key=len):
        if c and both[c] >= langid.MIN_COUNT[len(c)] and c[1:] in kept:
            kept.add(c)

    def plain(data):  # method C with exclusion, straight from the definition
        counts: dict = {}
        for c, s in contexts(pad(data)):
            counts.setdefault(c, Counter())[s] += 1
        bits, t = 0.0, pad(text)
        for i in range(n, len(t)):
            k = max(k for k in range(n + 1) if t[i - k : i] in kept)
            gone: set = set()
            while True:
                c = {s: m for s, m in counts.get(t[i - k : i], {}).items() if s not in gone}
                total, d = sum(c.values()), len(c)
                if t[i] in c:
                    bits -= math.log2(c[t[i]] / (total + d))
                    break
                if d:
                    bits -= math.log2(d / (total + d))
                gone |= set(c)
                if k == 0:
                    bits += math.log2(256 - len(gone))
                    break
                k -= 1
        return bits

    got = langid.code_lengths(model, [text])[0] / langid.COST_ONE
    assert np.allclose(got, [plain(rows[0][1]), plain(rows[1][1])], atol=1e-3)


def test_code_lengths_do_not_depend_on_batches(monkeypatch):
    model = langid.train([("x", b"abcabc abd " * 20), ("y", b"xyz zyx " * 20)])
    texts = [b"abc" * 50, b"", b"q", b"zyx abd " * 40]
    whole = langid.code_lengths(model, texts)
    monkeypatch.setattr(langid, "SLICE", 17)
    assert (langid.code_lengths(model, texts) == whole).all()


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.detect(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 !?", "a"), (4, "hello there", "en"), (4, "hello there", "en"), (None, "hallo du", "de"), (5, "x" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    got = langid.detect(df).collect()
    assert len(got) == 7 and {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert langid.detect(df.limit(0)).count() == 0


def test_grammar_weakens_hedged_insults():
    lexicon = {"idiot": 4.0}
    table, machine = toxicity.symbols(lexicon), toxicity.grammar()
    score = lambda t: toxicity.features(t, lexicon, table, machine)
    plain, negated, reported, aimed, threat, verb = (score(t) for t in ("that idiot", "never an idiot", "someone said that the idiot left", "you idiot", "we will hurt", "they hurt"))
    assert plain[1] == 4.0 and negated[1] == 0.0 and negated[2] > 0 and reported[1] == 0.0
    assert aimed[1] == 6.0 and threat[4] == 1 and verb[4] == 0
    assert score("said yes. idiot")[1] == 4.0  # a clause ends the reported speech
    assert score(None) == score("") == score("all is fine") == [0.0] * 7


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.detect(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1], got[got.toxic == 0]
    assert pos.predicted.mean() > 0.9 and neg.predicted.mean() < 0.01 and got.score.between(0, 1).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "fine"), (3, "fine"), (None, "x")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.detect(docs, none).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got)
    assert toxicity.reject(docs, none).columns == docs.columns and toxicity.detect(docs.limit(0), none).count() == 0


def test_long_texts_take_no_slots(spark, monkeypatch):
    for module in (langid, toxicity):
        monkeypatch.setattr(module, "SAMPLE_DOCS", 20)
        monkeypatch.setattr(module, "SAMPLE_CHARS", 50)
    short = [(i, f"short text {i}", "xx") for i in range(60)]
    void = [(100 + i, None if i % 2 else "", "xx") for i in range(300)]
    long = [(1000 + i, "long " * (20 + i % 7), "xx") for i in range(300)] + [(2000 + i, "only long " * (6 + i % 3), "yy") for i in range(9)]
    docs = spark.createDataFrame(short + void + long, "doc_id bigint, text string, lang string")
    drawn = langid.sample(docs)
    assert Counter(k for k, _ in drawn)["xx"] == 20 and all(t.startswith(b"short") for k, t in drawn if k == "xx") and any(k == "yy" for k, _ in drawn)
    labels = docs.select("doc_id", F.when(F.col("lang") == "yy", 0).otherwise(1).alias("toxic"))
    rows = toxicity.sample(docs, labels)
    assert Counter(y for _, y in rows)[1] == 20 and all(t.startswith("short") for t, y in rows if y) and any(y == 0 for _, y in rows)


def test_too_many_languages_fail(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    docs = spark.createDataFrame([(i, "some text", f"l{i % 4}") for i in range(60)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError):
        langid.sample(docs)
    assert {k for k, _ in langid.sample(docs.where("lang <> 'l0'"))} == {"l1", "l2", "l3"}


def test_sample_is_not_cut_to_fit(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert all(n > 3000 for n in Counter(y for _, y in toxicity.sample(docs, labels)).values())
