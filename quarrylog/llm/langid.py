"""Language ID (9): prediction by partial matching.

Per language a context tree of bytes up to ``ORDER`` deep, with frozen counts. A byte that a context has not
seen is coded by an escape (method C: d distinct symbols among n give the escape d/(n+d)) and by the next
shorter context, with symbols already ruled out excluded; below order 0, bytes unseen in training share what is
left evenly. So each context's probabilities over all 256 bytes sum to 1, and a text's code length is
exact up to the fixed-point costs (1/65536 bit), which are summed as integers: the same for any batching.

The trees of all languages are laid over one set of contexts, so scoring a byte is one look-up for the context
and one per language, vectorised.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrylog.llm.common import alone, by_value, draw, fold, runs

ORDER = 3
SAMPLE_DOCS = 400  # per language
SAMPLE_CHARS = 20_000  # longer documents are drawn only where a language has too few
MAX_LANGS = 200
MIN_COUNT = (1, 1, 3, 6)  # contexts of order k seen less often are cut
MAX_NODES = 60_000
SLICE = 1 << 21
COST_ONE = 1 << 16
TABLE_BYTES = 192 << 20  # of code lengths of all languages: with many of them the trees get fewer contexts
_ALNUM = re.compile(r"[^\W\d_]+")

by_value(__name__)


def has_letter(text: str) -> bool:
    """Whether a character is a letter (\\p{L}); numbers such as fractions and numerals are none."""
    return any(m.group().isalpha() or any(map(str.isalpha, m.group())) for m in _ALNUM.finditer(text))


def sample(docs: DataFrame, held_out: int = 1, folds: int = 3) -> list[tuple[str, bytes]]:
    """A bounded training sample: whole texts of at most SAMPLE_DOCS documents per language, drawn by a
    hash of the id among those outside the held-out fold. Texts of up to SAMPLE_CHARS characters come first; where a
    language has too few, longer ones follow, the shortest first, as far as SAMPLE_DOCS * SAMPLE_CHARS characters go.
    More than MAX_LANGS languages are an error."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & (fold(F.col("doc_id"), folds) != held_out))
    texts = known.select("doc_id", "lang", F.length("text").alias("_n"), "text")
    n = texts.select("lang").distinct().count()
    if n > MAX_LANGS:
        raise ValueError(f"{n} values of lang; at most {MAX_LANGS} can be learned")
    drawn = draw(texts.select("doc_id", "lang", "_n"), "lang", SAMPLE_DOCS, SAMPLE_CHARS)
    rows = texts.join(F.broadcast(drawn.distinct()), ["doc_id", "lang", "_n"], "left_semi")
    return [(r.lang, r.text.encode()) for r in rows.select("lang", "text").toLocalIterator()]


def train(rows: list[tuple[str, bytes]], order: int = ORDER) -> dict | None:
    """The frozen model of (language, text) rows; None without any."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    joined = {}
    seen = np.zeros(256, bool)
    for lang in langs:
        raw = [np.frombuffer(t, np.uint8) for k, t in sorted(rows) if k == lang]
        joined[lang] = raw
        for r in raw:
            seen[r] = True
    a = int(seen.sum())
    lut = np.full(256, a, np.int64)
    lut[seen] = np.arange(a)
    base = a + 2  # seen bytes, any unseen byte, the start of a text
    # counts of (context, symbol) per order and language
    grams: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order + 1)]
    for lang in langs:
        s = np.concatenate([np.concatenate([np.full(order, a + 1, np.int64), lut[r]]) for r in joined[lang]])
        here = np.flatnonzero(s != a + 1)
        key = np.zeros(len(here), np.int64)
        for k in range(order + 1):
            if k:
                key += s[here - k] * base**k
            grams[k][lang] = np.unique(key + s[here], return_counts=True)
    # contexts kept: frequent ones of each order whose shorter context is kept (context value = symbols, nearest lowest)
    nodes: list[np.ndarray] = [np.zeros(1, np.int64)]
    room = min(MAX_NODES, TABLE_BYTES // (4 * len(langs) * (a + 1)))
    for k in range(1, order + 1):
        allk = np.concatenate([g[0] // base for g in grams[k].values()])
        n = np.concatenate([g[1] for g in grams[k].values()])
        ctx, inv = np.unique(allk, return_inverse=True)
        total = np.bincount(inv, n)
        keep = (total >= MIN_COUNT[min(k, len(MIN_COUNT) - 1)]) & np.isin(ctx % base ** (k - 1), nodes[k - 1])
        best = np.flatnonzero(keep)[np.argsort(-total[keep], kind="stable")][: max(0, room)]
        nodes.append(np.sort(ctx[best]))
        room -= len(best)
    start = np.cumsum([0] + [len(x) for x in nodes])
    parents = [np.zeros(1, np.int64)] + [start[k - 1] + np.searchsorted(nodes[k - 1], nodes[k] % base ** (k - 1)) for k in range(1, order + 1)]
    table = np.zeros((len(langs), start[-1], a + 1), np.int32)
    for i, lang in enumerate(langs):
        table[i] = _costs(nodes, start, parents, [g[lang] for g in grams], base, a)
    # the longest kept context of every window of `order` symbols
    lookup = np.zeros(base**order, np.int32)
    window = np.arange(base**order, dtype=np.int64)
    for k in range(1, order + 1):
        low = window % base**k
        at = np.minimum(np.searchsorted(nodes[k], low), max(0, len(nodes[k]) - 1))
        if len(nodes[k]):
            hit = nodes[k][at] == low
            lookup[hit] = start[k] + at[hit]
    return {"langs": langs, "lut": lut, "a": a, "order": order, "lookup": lookup, "table": table.reshape(len(langs), -1)}


def _costs(nodes, start, parents, grams, base, a) -> np.ndarray:
    """Code lengths of every symbol in every context for one language, in 1/65536 bits."""
    count = np.zeros((start[-1], a), np.float32)
    for k, (key, n) in enumerate(grams):
        ctx, sym = key // base, key % base
        if len(nodes[k]):
            at = np.minimum(np.searchsorted(nodes[k], ctx), len(nodes[k]) - 1)
            ok = (nodes[k][at] == ctx) & (sym < a)
            count[start[k] + at[ok], sym[ok]] = n[ok]
    cost = np.zeros((start[-1], a + 1), np.float64)
    for k in range(len(nodes)):
        for lo in range(start[k], start[k + 1], 4096):
            rows = np.arange(lo, min(lo + 4096, start[k + 1]))
            left = np.ones((len(rows), a), bool)  # symbols not coded yet
            bits = np.zeros((len(rows), a + 1))
            spent = np.zeros(len(rows))
            at, level = rows, k
            while True:
                c = np.where(left, count[at], 0)
                n, d = c.sum(1), (c > 0).sum(1)
                new = c > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    bits[:, :a] = np.where(new, spent[:, None] - np.log2(c / (n + d)[:, None]), bits[:, :a])
                    spent = spent + np.where(d > 0, -np.log2(d / (n + d)), 0.0)
                left &= ~new
                if level == 0:
                    break
                at = parents[level][at - start[level]]
                level -= 1
            rest = left.sum(1) + (256 - a)  # bytes this language has not seen at all
            flat = spent + np.log2(np.maximum(rest, 1))
            bits[:, :a] = np.where(left, flat[:, None], bits[:, :a])
            bits[:, a] = flat
            cost[rows] = bits
    return np.round(cost * COST_ONE).astype(np.int32)


def code_lengths(model: dict, texts: list[bytes]) -> np.ndarray:
    """(texts x languages) code lengths in 1/65536 bits. Memory is bounded: texts are joined up to SLICE
    bytes, and a longer text is scored in slices that see the bytes before them."""
    out = np.zeros((len(texts), len(model["langs"])), np.int64)
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if group and size + len(t) > SLICE:
            _score(model, texts, group, out)
            group, size = [], 0
        group.append(i)
        size += len(t)
    _score(model, texts, group, out)
    return out


def _score(model: dict, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
    k, a, lut = model["order"], model["a"], model["lut"]
    base, width = a + 2, a + 1
    group = [i for i in group if texts[i]]
    if not group:
        return
    if len(group) == 1 and len(texts[group[0]]) > SLICE:
        t, i = texts[group[0]], group[0]
        for lo in range(0, len(t), SLICE):
            before = lut[np.frombuffer(t[max(0, lo - k) : lo], np.uint8)] if lo else np.zeros(0, np.int64)
            s = np.concatenate([np.full(k - len(before), a + 1, np.int64), before, lut[np.frombuffer(t[lo : lo + SLICE], np.uint8)]])
            out[i] += _sums(model, s, np.zeros(1, np.int64), k, base, width)[:, 0]
        return
    lengths = np.array([len(texts[i]) for i in group])
    starts = np.concatenate([[0], np.cumsum(lengths + k)[:-1]])
    s = np.full(int((lengths + k).sum()), a + 1, np.int64)
    mask = np.ones(len(s), bool)
    for j in range(k):
        mask[starts + j] = False
    s[mask] = lut[np.frombuffer(b"".join(texts[i] for i in group), np.uint8)]
    out[group] = _sums(model, s, starts, k, base, width).T


def _sums(model, s, starts, k, base, width) -> np.ndarray:
    """Sums of costs from each start on; the k symbols at a start are context only."""
    ctx = np.zeros(len(s) - k, np.int64)
    for j in range(1, k + 1):
        ctx += s[k - j : len(s) - j] * base ** (j - 1)
    index = model["lookup"][ctx].astype(np.int64)
    index *= width
    index += np.minimum(s[k:], width - 1)
    real = s[k:] < width  # a start symbol of the next text costs nothing
    sums = np.zeros((len(model["table"]), len(starts)), np.int64)
    for i, costs in enumerate(model["table"]):
        c = costs[index]
        c *= real
        sums[i] = np.add.reduceat(c, starts, dtype=np.int64)
    return sums


def predict(docs: DataFrame, model: dict | None, held_out: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the prediction under equal priors) and bits per byte.

    Texts that are NULL, empty or without a letter are `und` with score 0; equal code lengths go to the
    first name. Rows, repeated ones too, stay one for one; other input columns are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("langid")
        m = shared.value
        for part in (batch.slice(*run) for batch in batches for run in runs(batch.column("text"))):
            texts = part.column("text").to_pylist()
            named, sure, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            use = [i for i, t in enumerate(texts) if m and t and has_letter(t)]
            if use:
                raw = [texts[i].encode() for i in use]
                bits = code_lengths(m, raw) / COST_ONE
                best = bits.argmin(1)
                gap = np.minimum(bits - bits[np.arange(len(use)), best][:, None], 1000)
                for i, b, p, x in zip(use, best, 1 / np.exp2(-gap).sum(1), bits.min(1) / [len(r) for r in raw]):
                    named[i], sure[i], rate[i] = m["langs"][b], p, x
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(named, pa.string()), pa.array(sure), pa.array(rate)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double")


def detect(docs: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """Trains on the sample outside the held-out fold and predicts every document."""
    return predict(docs, train(sample(docs, held_out, folds)), held_out, folds)
