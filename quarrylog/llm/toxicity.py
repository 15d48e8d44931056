"""Toxicity (3): a weighted finite-state pattern grammar.

Words of a clause are mapped to symbols: insulting word (I), threat verb (T), target (Y), modal (M), negation (N), reporting
verb or quotation (R), other (O). Five transducers are composed into one machine that reads a clause once:

* insult: an insulting word within three words of another one belongs to one phrase with it and weighs more;
* negation: an insult or threat within three words of a negation is weakened;
* reported speech: within eight words of a reporting verb or a quotation mark it is weakened;
* threat: a threat verb counts only shortly after a modal, otherwise it is an ordinary word;
* target: what follows an address within four words weighs more.

A matched insult or threat carries its lexicon weight times the path's weight. What a document's clauses give
in sum, at most, hedged, aimed and by length goes through a logistic model. Lexicon weights (log odds) and
the model are learned from a bounded, hash-drawn sample of labelled rows outside the held-out fold; threat and
function words are given. Ids, language and source are no inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrylog.llm.common import by_value, cached, draw, fold, runs

SAMPLE_DOCS = 6000  # per label value; documented bound on what training gathers
SAMPLE_CHARS = 20_000  # longer documents are drawn only where a value has too few
LEXICON = 5000
MIN_DOCS = 4
LONG_CHARS = 1 << 20  # longer texts and clauses are read word by word, not as lists
MIN_LOG_ODDS = 1.0  # lower bound (one-sided 95 %) of a word's log odds

THREATS = frozenset("kill hurt destroy murder stab shoot strangle töten verletzen umbringen tuer blesser frapper matar golpear herir".split())
TARGETS = frozenset("you your they them he she him her these those du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ellos ellas".split())
MODALS = frozenset("will shall gonna going must should werde wirst wird muss vais vas va voy vas debe".split())
NEGATIONS = frozenset("not never no nor isn't without nicht nie kein keine ne pas jamais nunca jamás sin".split())
REPORTS = frozenset("said says wrote writes called quoted claimed sagte schrieb dit écrit dijo escribió".split())
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
CLAUSE = re.compile(r"[.!?;:\n]+")
QUOTES = frozenset("\"“”„«»")

by_value(__name__)


class Transducer:
    """Deterministic: arcs[state][symbol] = (next state, output symbol, weight); a missing arc copies the symbol
    to ``other`` of the state."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs[state].get(symbol) or (self.arcs[state]["*"][0], symbol, 1.0)

    def __matmul__(self, after: "Transducer") -> "Transducer":
        """Composition: this machine's output is read by ``after``; weights multiply."""
        symbols = set("ITYMNROXithx*")
        arcs, todo = {}, [(self.start, after.start)]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol in symbols:
                a, out, w1 = self.step(state[0], symbol) if symbol != "*" else (*self.arcs[state[0]]["*"], 1.0)[:1] + ("*", 1.0)
                if out == "*":
                    b, out2, w2 = after.arcs[state[1]]["*"][0], "*", 1.0
                else:
                    b, out2, w2 = after.step(state[1], out)
                arcs[state][symbol] = ((a, b), out2, w1 * w2)
                todo.append((a, b))
        return Transducer(arcs, (self.start, after.start))


def window(triggers: str, span: int, effect: dict[str, tuple[str, float]], otherwise: dict[str, tuple[str, float]] | None = None) -> Transducer:
    """For ``span`` words after a trigger, symbols are rewritten by ``effect``, else by ``otherwise``."""
    arcs: dict = {}
    for left in range(span + 1):
        rules = effect if left else otherwise or {}
        arcs[left] = {"*": (max(0, left - 1),)} | {s: (max(0, left - 1), out, w) for s, (out, w) in rules.items()}
        arcs[left] |= {t: (span, t, 1.0) for t in triggers}
    return Transducer(arcs)


def parts() -> list[Transducer]:
    """The transducers in their order. Lower case marks a hedged match, X a threat, x a hedged one."""
    insult = window("I", 3, {})
    for left in range(1, 4):
        insult.arcs[left]["I"] = (3, "I", 1.25)
    negation = window("N", 3, {"I": ("i", 0.5), "T": ("t", 0.5)})
    reported = window("R", 8, {"I": ("i", 0.5), "T": ("t", 0.5), "i": ("i", 0.5), "t": ("t", 0.5)})
    threat = window("M", 4, {"T": ("X", 1.0), "t": ("x", 1.0)}, {"T": ("O", 1.0), "t": ("O", 1.0)})
    target = window("Y", 4, {s: (s, 1.5) for s in "IiXx"})
    return [insult, negation, reported, threat, target]


def grammar() -> Transducer:
    return reduce(Transducer.__matmul__, parts())


def symbols(lexicon: dict[str, float]) -> dict[str, str]:
    table = {w: s for words, s in ((TARGETS, "Y"), (MODALS, "M"), (NEGATIONS, "N"), (REPORTS | QUOTES, "R"), (THREATS, "T")) for w in words}
    return table | dict.fromkeys(lexicon, "I")


def _clauses(lower: str) -> Iterator[str]:
    if len(lower) <= LONG_CHARS:
        yield from CLAUSE.split(lower)
        return
    at = 0
    for mark in CLAUSE.finditer(lower):
        yield lower[at : mark.start()]
        at = mark.end()
    yield lower[at:]


def features(text: str | None, lexicon: dict[str, float], table: dict[str, str], machine: Transducer) -> list[float]:
    """[sum, largest clause, hedged sum, aimed sum, threats, sum per root of words, any] of a whole text."""
    lower = (text or "").lower()
    if len(lower) <= LONG_CHARS:
        words = WORD.findall(lower)
        n = len(words)
        if lexicon.keys().isdisjoint(words) and THREATS.isdisjoint(words):
            return [0.0] * 7
    else:
        n = sum(1 for _ in WORD.finditer(lower))
    total = best = hedged = aimed = threats = 0.0
    for clause in _clauses(lower):
        if len(clause) <= LONG_CHARS:
            tokens = WORD.findall(clause)
            if lexicon.keys().isdisjoint(tokens) and THREATS.isdisjoint(tokens):
                continue
        else:
            tokens = (m.group() for m in WORD.finditer(clause))
        state, here = machine.start, 0.0
        for token in tokens:
            symbol = table.get(token, "O")
            state, out, weight = machine.arcs[state][symbol]
            if out in "IiXx":
                value = weight * (lexicon.get(token, 0.0) if out in "Ii" else 3.0)
                if out in "ix":
                    hedged += value
                else:
                    here += value
                if weight > 1:
                    aimed += value
                threats += out == "X"
        total += here
        best = max(best, here)
    strength = math.log1p(max(0.0, total + hedged))
    return [strength, best, math.log1p(max(0.0, hedged)), math.log1p(max(0.0, aimed)), threats, (total + hedged) / math.sqrt(n + 5), 1.0 if total + hedged > 0 else 0.0]


def sample(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> list[tuple[str, int]]:
    """(text, toxic) of at most SAMPLE_DOCS labelled documents per value, outside the held-out fold. Several
    labels of one document: the largest counts. Texts of up to SAMPLE_CHARS characters come first, by a hash of the id;
    where a value has too few, longer ones follow, the shortest first, as far as SAMPLE_DOCS * SAMPLE_CHARS characters go."""
    one = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = one.where(fold(F.col("doc_id"), folds) != held_out)
    texts = docs.where(F.length("text") > 0).select("doc_id", F.length("text").alias("_n"), "text")
    drawn = draw(one.join(texts.select("doc_id", "_n"), "doc_id"), "toxic", SAMPLE_DOCS, SAMPLE_CHARS)
    rows = texts.join(F.broadcast(drawn.select("doc_id", "_n", "toxic").distinct()), ["doc_id", "_n"])
    return [(r.text, r.toxic) for r in rows.select("text", "toxic").orderBy("doc_id", "text").toLocalIterator()]


def train(rows: list[tuple[str, int]]) -> dict:
    """Lexicon and logistic weights; without both kinds of rows, a model that scores 0 everywhere."""
    n = Counter(y for _, y in rows)
    if not n[0] or not n[1]:
        return {"lexicon": {}, "weights": np.zeros(7), "bias": -6.0, "mean": np.zeros(7), "scale": np.ones(7)}
    # words that more toxic than clean documents have, by documents
    seen: list[Counter] = [Counter(), Counter()]
    for t, y in rows:
        seen[y].update({w for w in WORD.findall(t.lower()) if len(w) > 2})
    weigh = lambda a, b: math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
    worth = {w for w, c in seen[1].items() if c >= MIN_DOCS and weigh(c, seen[0][w]) >= MIN_LOG_ODDS}
    del seen
    # then evidence is counted in distinct preceding words: a passage copied into many documents is one piece of it
    before: dict[str, tuple[set, set]] = {w: (set(), set()) for w in worth}
    found = []
    for t, y in rows:
        words = WORD.findall(t.lower())
        for last, w in zip(["", *words], words):
            if w in before:
                before[w][y].add(last)
        found.append(worth.intersection(words))
    have = [{w: len(b[y]) for w, b in before.items()} for y in (0, 1)]
    odds = {w: weigh(have[1][w], have[0][w]) for w in worth if have[1][w] >= MIN_DOCS}
    sure = {w: o - 1.65 * math.sqrt(1 / (have[1][w] + 0.5) + 1 / (have[0][w] + 0.5)) for w, o in odds.items()}
    top = sorted((w for w in odds if sure[w] >= MIN_LOG_ODDS), key=lambda w: (-odds[w] * have[1][w], w))[:LEXICON]
    lexicon = {w: odds[w] for w in top}
    machine, table = grammar(), symbols(lexicon)
    # a word's own document is left out of its weight, so that the model is not fitted to what it has seen
    x = []
    for (text, y), words in zip(rows, found):
        own = {w: weigh(have[1][w] - (y == 1), have[0][w] - (y == 0)) for w in words if w in lexicon}
        x.append(features(text, lexicon | own, table, machine) if own else features(text, lexicon, table, machine))
    x, y = np.array(x), np.array([y for _, y in rows], float)
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * 7 + [0.0])
    for _ in range(30):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(8), z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"lexicon": lexicon, "weights": w[:-1], "bias": float(w[-1]), "mean": mean, "scale": scale}


def rater(model: dict) -> Callable[[pa.Array], np.ndarray]:
    """Scores of an array of texts; made once in a task."""
    lexicon, table, machine = model["lexicon"], symbols(model["lexicon"]), cached(("toxicity",), grammar)

    def rate(texts: pa.Array) -> np.ndarray:
        x = np.array([features(t, lexicon, table, machine) for t in texts.to_pylist()]).reshape(-1, 7)
        return 1 / (1 + np.exp(-np.clip((x - model["mean"]) / model["scale"] @ model["weights"] + model["bias"], -30, 30)))

    return rate


def score(docs: DataFrame, model: dict, held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted for every document. Empty and NULL texts get the score of a text without
    matches; texts of any length are scored whole; repeated rows stay; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = rater(shared.value)
        for batch in batches:
            for at, size in runs(batch.column("text")):
                part = batch.slice(at, size)
                p = rate(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """Trains on the labelled sample outside the held-out fold and scores every document."""
    return score(docs, train(sample(docs, labels, held_out, folds)), held_out, folds)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, that are not predicted toxic. Rows pass through as Arrow; only texts become
    Python objects, a run at a time. Repeated rows share a fate; NULL and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = rater(shared.value)
        for batch in batches:
            for first, size in runs(batch.column(at)):
                part = batch.slice(first, size)
                yield part.filter(pa.array(rate(part.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
