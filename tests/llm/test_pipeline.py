import importlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from quarrylog.llm import unigram


def test_stages(spark, tmp_path):
    r = random.Random(9)
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    words = [f"word{name(i)}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(60)) for i in range(120)]
    toxic = [(200 + i, text(30) + f" w{name(i)} idiot {text(5)} v{name(i)} moron {text(5)} u{name(i)} clown " + text(20)) for i in range(60)]
    item = text(25)
    leak = [(300, text(20) + " " + item + " " + text(20))]
    copy = [(400, docs[5][1] + " end"), (401, docs[5][1]), (-1, docs[6][1])]
    personal = [(500, text(10) + " mail bob@example.org now " + text(10)), (501, ""), (502, None), (503, "one")]
    rows = docs + toxic + leak + copy + personal
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, _ in docs] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {i for i, _ in toxic} | {300, 400, 401, 6}
    assert set(out) == {i for i, _ in rows} - gone
    seg = unigram.Segmenter(unigram.load())
    want = dict(rows)
    for i, x in out.items():
        t = want[i] if i != 500 else want[i].replace("bob@example.org", "[EMAIL]")
        assert x.decoded == t and x.ids == (None if t is None else seg.encode(t).tolist())


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
