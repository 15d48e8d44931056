"""Unigram segmentation with a public SentencePiece vocabulary: encode, decode (2) and count (8).

The pieces and scores of a model file are read as a unigram model: a text's pieces are the segmentation of
the largest total score. The file at hand was made for merges; its scores (minus the rank) rank segmentations just
as well, and the same file with the model type set to unigram gives the same ids in public libraries (tests).

Scores are scaled to integers (exact for scores that are multiples of 1/65536), so sums are exact and
associative, in any order and at any length. Rules: a space becomes U+2581, one is put in front of a text; among
equally scored last pieces the one that starts first wins; a character that is no piece scores
10 below the lowest piece and is written as its UTF-8 bytes' pieces. A literal U+2581 is written as
bytes too, so that decoding is exact. An empty text has no pieces; NULL stays NULL.

No piece has U+2581 after another character, so every segmentation breaks before a run of it; and
characters found in no piece stand alone. At these forced breaks a text falls into words, each segmented once
and remembered (a bounded memory). The loader refuses a vocabulary without that property.

Giant texts are cut into chunks by position. A piece may hang over a chunk's end, so a chunk maps the overhang
at its start to the overhang at its end: a max-plus transfer matrix. Matrices are made side by side and combined
by a parallel scan: blocks of ``SCAN`` chunks are multiplied up side by side, the products of blocks are scanned in turn, level by
level, and what stands before a block goes into it. With the score vector before it each chunk is backtraced by itself, for
every overhang it can end with; a last pass picks the one that the next chunk starts from. A literal U+2581 is
carried through a worker as a lone surrogate, which no text has, so no character is mistaken for another.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import accumulate
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarrylog.llm.common import by_value, cached, drop_written, runs, written

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SCALE = 1 << 16
UNK_PENALTY = 10
GIANT_CHARS = 32_768
CHUNK_CHARS = 16_384
SCAN = 64  # matrices that one task multiplies up
MARK = "\ud800"  # a literal U+2581 inside a worker
SNAP_CHARS = 256  # a chunk's border moves to the first forced break within so many characters
MEMO = 250_000  # words per generation, two generations
NEVER = -(1 << 80)

by_value(__name__)


def load(path: str = MODEL_FILE) -> dict:
    """Pieces, integer scores and byte pieces of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return vocabulary([(p.piece, p.score, p.type) for p in proto.pieces])


def vocabulary(pieces: list[tuple[str, float, int]]) -> dict:
    """Model of (piece, score, type) rows; types as in model files: 1 normal, 4 user defined, 6 byte."""
    normal = [(p, i, round(s * SCALE)) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4)]
    lowest = min((round(s * SCALE) for _, s, kind in pieces if kind == 1), default=0)
    inner = [p for p, _, _ in normal if SPACE in p.lstrip(SPACE)]
    if inner:
        raise ValueError(f"pieces with a space mark inside are not supported: {inner[:3]}")
    byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
    unk = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
    text = [p.replace(SPACE, " ").encode() for p, _, _ in pieces]
    for b, i in byte.items():
        text[i] = bytes([b])
    for i, (_, _, kind) in enumerate(pieces):
        if kind in (2, 3):
            text[i] = b""
    return {"normal": normal, "unk_score": lowest - UNK_PENALTY * SCALE, "byte": byte, "unk": unk, "text": text, "digest": hashlib.sha256(repr(normal).encode()).hexdigest()}


class Segmenter:
    """Best paths over one vocabulary; lives in a Python worker."""

    def __init__(self, model: dict):
        import ahocorasick

        self.model = model
        self.found = ahocorasick.Automaton()
        for piece, i, score in model["normal"]:
            self.found.add_word(piece, (len(piece), i, score))
        self.found.make_automaton()
        self.longest = max((len(p) for p, _, _ in model["normal"]), default=1)
        self.known = {c for p, _, _ in model["normal"] for c in p}
        self.single = {p for p, _, _ in model["normal"] if len(p) == 1}
        self.unk_score = model["unk_score"]
        marks = "".join(c for c in "\n\t\r" if c not in self.known)
        self.alone = re.compile(f"([{marks}])") if marks else None
        self.plain = "\n" not in self.known  # lines can be cut apart
        self.ids = _Memo(lambda w: struct.pack(f"<{len(ids := self.word(w)[1])}i", *ids))
        self.sizes = _Memo(self.count_word)
        # a character that is no piece counts once, by its first byte
        worth = {i: score for _, i, score in model["normal"]} | {i: self.unk_score if b >> 6 != 2 else 0 for b, i in model["byte"].items()}
        self.worth = np.array([worth.get(i, self.unk_score) for i in range(len(model["text"]))], np.int64)

    def unknown(self, c: str) -> list[int]:
        """Pieces of a character that is no piece: its bytes."""
        c = SPACE if c == MARK else c
        byte = self.model["byte"]
        return [byte.get(b, self.model["unk"]) for b in c.encode()] if byte else [self.model["unk"]]

    def path(self, text: str, start: dict[int, int], last: int, end: int) -> tuple[list, list]:
        """Best scores at 0..end from the given start scores, with pieces that begin before ``last``; and the
        (length, id) of the last piece there, id None for an unknown character."""
        best, back = [NEVER] * (end + 1), [None] * (end + 1)
        for p, s in start.items():
            best[p] = s
        by_end: dict[int, list] = {}
        for e, hit in self.found.iter(text):
            by_end.setdefault(e + 1, []).append(hit)
        single, unk = self.single, self.unk_score
        for e in range(1, end + 1):
            top, via = best[e], None
            for size, i, score in sorted(by_end.get(e, ()), reverse=True):  # the first start wins ties
                s = e - size
                if s >= 0 and s < last and best[s] > NEVER and best[s] + score > top:
                    top, via = best[s] + score, (size, i)
            if e - 1 < last and best[e - 1] > NEVER and text[e - 1] not in single and best[e - 1] + unk > top:
                top, via = best[e - 1] + unk, (1, None)
            best[e], back[e] = top, via
        return best, back

    def trace(self, text: str, back: list, at: int) -> tuple[list[int], int]:
        """Ids of the best path that ends at ``at``, and where it starts."""
        out: list[list[int]] = []
        while back[at] is not None:
            size, i = back[at]
            out.append([i] if i is not None else self.unknown(text[at - 1]))
            at -= size
        return [i for ids in reversed(out) for i in ids], at

    def word(self, text: str) -> tuple[int, list[int]]:
        """Score and ids between two forced breaks, by the matches that the automaton lists: those that end at a place from
        the longest on, so that strict comparison keeps the first start among ties."""
        n = len(text)
        best, via = [0] + [NEVER] * n, [None] * (n + 1)
        single, unk, done = self.single, self.unk_score, 0
        for e, hit in self.found.iter(text):
            while done < e:  # an unknown character is the last candidate at its end
                done += 1
                if text[done - 1] not in single and best[done - 1] + unk > best[done]:
                    best[done], via[done] = best[done - 1] + unk, None
            score = best[e + 1 - hit[0]] + hit[2]
            if score > best[e + 1]:
                best[e + 1], via[e + 1] = score, hit
        while done < n:
            done += 1
            if text[done - 1] not in single and best[done - 1] + unk > best[done]:
                best[done], via[done] = best[done - 1] + unk, None
        out, at = [], n
        while at:
            hit = via[at]
            if hit is None:
                at -= 1
                out += reversed(self.unknown(text[at]))
            else:
                out.append(hit[1])
                at -= hit[0]
        return best[n], out[::-1]

    def count_word(self, text: str) -> int:
        """Number of pieces only: best score and count are carried forward together, nothing is traced."""
        n = len(text)
        best, count = [NEVER] * (n + 1), [0] * (n + 1)
        best[0] = 0
        single, unk, many = self.single, self.unk_score, len(self.model["byte"]) > 0
        done = 0

        def lone(e: int) -> None:  # an unknown character is the last candidate at its end
            c = text[e - 1]
            if c not in single and best[e - 1] + unk > best[e]:
                best[e], count[e] = best[e - 1] + unk, count[e - 1] + (len(c.encode()) if many else 1)

        for e, (size, _, score) in self.found.iter(text):
            e += 1
            while done < e - 1:
                done += 1
                lone(done)
            s = best[e - size] + score
            if s > best[e]:
                best[e], count[e] = s, count[e - size] + 1
        while done < n:
            done += 1
            lone(done)
        return count[n]

    def words(self, text: str) -> Iterator[str | None]:
        """The pieces of a text between forced breaks, in order, with space marks; None for a literal mark.
        Line breaks and tabs stand alone where the vocabulary does not know them."""
        for i, part in enumerate(text.split(SPACE)):
            if i:
                yield None
            for bit in self.alone.split(part.replace(" ", SPACE)) if self.alone else [part.replace(" ", SPACE)]:
                at = 0
                while (cut := self._break(bit, at)) > 0:
                    yield bit[at:cut]
                    at = cut
                if bit[at:]:
                    yield bit[at:]

    @staticmethod
    def _break(text: str, at: int) -> int:
        """The next place after ``at`` where a run of space marks begins behind another character."""
        cut = at
        while cut < len(text) and text[cut] == SPACE:
            cut += 1
        return text.find(SPACE, cut + (cut == at)) if cut < len(text) else -1

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self._ids(text, True) if text else np.zeros(0, "<i4")

    def _ids(self, text: str, whole: bool = False) -> np.ndarray:
        """Ids of a stretch between forced breaks; a whole text has a space before it."""
        memo, mark = self.ids, np.array(self.unknown(SPACE), "<i4").tobytes()
        out: list[bytes] = []
        for i, line in enumerate(text.split("\n") if self.plain else [text]):
            if i:
                out.append(memo["\n"])
            if self.plain and line and line[0] != " " and "  " not in line and SPACE not in line:
                head, *rest = line.split(" ")
                out.append(memo[SPACE + head if whole and not i else head])
                out += [memo[SPACE + w] for w in rest]
            else:
                out += [mark if w is None else memo[w] for w in self.words(" " + line if whole and not i else line)]
        return np.frombuffer(b"".join(out), "<i4")

    def count(self, text: str) -> int:
        """len(encode(text)) without the ids."""
        if not text:
            return 0
        memo, n = self.sizes, 0
        for i, line in enumerate(text.split("\n") if self.plain else [text]):
            if i:
                n += memo["\n"]
            if self.plain and line and line[0] != " " and "  " not in line and SPACE not in line:
                head, *rest = line.split(" ")
                n += memo[head if i else SPACE + head] + sum([memo[SPACE + w] for w in rest])
            else:
                n += sum(len(self.unknown(SPACE)) if w is None else memo[w] for w in self.words(line if i else " " + line))
        return n

    def decode(self, ids: np.ndarray) -> str:
        text = self.model["text"]
        raw = b"".join([text[i] for i in ids.tolist()]).decode(errors="replace")
        return raw[1:] if raw[:1] == " " else raw

    # Chunks: text is normalised, with one character before the chunk (none at a text's start) and a look-ahead.
    def forced(self, text: str, at: int) -> bool:
        """No piece crosses the place before text[at]."""
        a, b = text[at - 1], text[at]
        return (b == SPACE and a != SPACE) or a not in self.known or b not in self.known

    def border(self, text: str, at: int) -> int:
        """The chunk's border: the first forced break in reach, else the place itself."""
        return next((p for p in range(max(at, 1), min(at + SNAP_CHARS, len(text))) if self.forced(text, p)), at)

    def chunk_paths(self, text: str, start: int, end: int, entry: dict[int, int]):
        """For entry scores by overhang: (exit overhang, score, entry overhang, ids) per reachable exit."""
        if set(entry) == {0} and (end == len(text) or self.forced(text, end)):  # nothing hangs over: word by word
            ids = self._ids(text[start:end].replace(SPACE, " ").replace(MARK, SPACE))
            return [(0, entry[0] + int(self.worth[ids].sum()), 0, ids)]
        body = text[start : end + self.longest - 1]
        size = end - start
        first = {i: s for i, s in entry.items() if i >= size}
        out = [(i - size, s, i, []) for i, s in first.items()]
        inside = {i: s for i, s in entry.items() if i < size}
        if inside:
            best, back = self.path(body, inside, size, min(len(body), size + self.longest - 1))
            starts = set(inside)
            for e in range(size, len(best)):
                if best[e] > NEVER and back[e] is not None:
                    ids, at = self.trace(body, back, e)
                    assert at in starts
                    out.append((e - size, best[e], at, ids))
        merged: dict[int, tuple] = {}
        for j, s, i, ids in out:
            if j not in merged or s > merged[j][1]:
                merged[j] = (j, s, i, ids)
        return sorted(merged.values())


class _Memo(dict):
    """Remembers results up to a bound: when it is full it becomes the old generation, out of which words that
    come again are taken over; the words of the old generation before it are forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


def segmenter(model: dict) -> Segmenter:
    return cached(("unigram", model["digest"]), lambda: Segmenter(model))


def compose(a: dict[int, dict[int, int]], b: dict[int, dict[int, int]]) -> dict[int, dict[int, int]]:
    """Max-plus product of two transfer matrices (associative)."""
    out: dict[int, dict[int, int]] = {}
    for i, row in a.items():
        for j, s in row.items():
            for k, t in b.get(j, {}).items():
                if s + t > out.setdefault(i, {}).get(k, NEVER):
                    out[i][k] = s + t
    return out


def _packed(matrix: dict[int, dict[int, int]]) -> str:
    return ";".join(f"{i},{j},{s}" for i, row in matrix.items() for j, s in row.items())


def _unpacked(text: str) -> dict[int, dict[int, int]]:
    out: dict[int, dict[int, int]] = {}
    for i, j, s in (map(int, cell.split(",")) for cell in filter(None, text.split(";"))):
        out.setdefault(i, {})[j] = s
    return out


def scan_entries(matrices: DataFrame, block: int = SCAN) -> DataFrame:
    """(key, k, before) of (key, k, matrix): the product of all matrices of a key before k, NULL for the first. A task
    multiplies up ``block`` matrices; the products of the blocks are scanned the same way, so no task sees a whole key."""
    rows = matrices.select("key", F.floor(F.col("k") / F.lit(block)).cast("int").alias("b"), "k", "matrix")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        made = list(accumulate(map(_unpacked, pdf["matrix"]), compose))
        last = [False] * (len(made) - 1) + [True]
        return pd.DataFrame({"key": pdf["key"], "b": pdf["b"], "k": pdf["k"], "inner": [None, *map(_packed, made[:-1])], "whole": [_packed(m) if x else None for m, x in zip(made, last)]})

    done = written(rows.groupBy("key", "b").applyInPandas(inside, "key string, b int, k int, inner string, whole string"), "scan")
    blocks = done.where("whole IS NOT NULL").select("key", F.col("b").alias("k"), F.col("whole").alias("matrix"))
    if not blocks.where("k > 0").limit(1).count():
        return done.select("key", "k", F.col("inner").alias("before"))
    outer = scan_entries(blocks, block).select("key", F.col("k").alias("b"), F.col("before").alias("outer"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [o if i is None else i if o is None else _packed(compose(_unpacked(o), _unpacked(i))) for o, i in zip(pdf["outer"], pdf["inner"])]
            yield pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "before": both})

    return done.join(outer, ["key", "b"]).select("key", "k", "outer", "inner").mapInPandas(join, "key string, k int, before string")


def count_tokens(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """(8) doc_id and n_tokens of every whole text; NULL texts have NULL, empty ones 0. Rows stay one for one."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches):
        seg = segmenter(shared.value)
        for batch in batches:
            texts, n = batch.column("text"), []
            for at, size in runs(texts):
                n += [None if t is None else seg.count(t) for t in texts.slice(at, size).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def _id_lists(arrays: list[np.ndarray | None]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    offsets[1:] = np.cumsum([0 if a is None else len(a) for a in arrays])
    values = np.concatenate([a for a in arrays if a is not None and len(a)] or [np.zeros(0, "<i4")])
    nulls = pa.array([a is None for a in arrays] + [False], pa.bool_()) if any(a is None for a in arrays) else None
    at = pa.array(offsets, pa.int32(), mask=np.array(nulls.to_pylist()) if nulls is not None else None)
    return pa.ListArray.from_arrays(at, pa.array(values, pa.int32()))


def encode(docs: DataFrame, model_file: str = MODEL_FILE, giant: int = GIANT_CHARS, chunk: int = CHUNK_CHARS, decoded: bool = False) -> DataFrame:
    """(2) doc_id and ids array<int> of every whole text; with ``decoded`` also the text decoded from the ids, in the
    same pass. Texts over ``giant`` characters go through chunks, once per distinct text. NULL texts have NULL
    ids, empty ones no ids; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches):
        seg = segmenter(shared.value)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for at, size in runs(texts):
                ids = [None if t is None else seg.encode(t) for t in texts.slice(at, size).to_pylist()]
                out = [doc_ids.slice(at, size), _id_lists(ids)]
                if decoded:
                    out.append(pa.array([None if i is None else seg.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]
    rows = docs.select("doc_id", "text")
    small = rows.where(F.col("text").isNull() | (F.length("text") <= giant)).mapInArrow(run, "doc_id bigint, ids array<int>" + (", decoded string" if decoded else ""))
    big = rows.where(F.length("text") > giant).withColumn("key", F.md5("text"))
    done = encode_giants(big.select("key", "text").dropDuplicates(["key"]), shared, chunk)
    large = big.select("doc_id", "key").join(done, "key").select("doc_id", "ids")
    if decoded:
        large = decode(large, model_file, keep=("ids",)).withColumnRenamed("text", "decoded")
    return small.unionByName(large)


def encode_giants(texts: DataFrame, shared, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(key, ids) of distinct (key, text) rows by chunks; see the module's text."""

    def cut(batches):
        for part in (batch.slice(*run) for batch in batches for run in runs(batch.column("text"))):
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                text = " " + text
                n = -(-len(text) // chunk)
                for k in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([text[max(0, k * chunk - 1) : (k + 1) * chunk + SNAP_CHARS + 64]])], ["key", "k", "n", "part"])

    def chunks(batches):
        """Rows one by one, the text normalised: spaces become marks, literal marks another thing."""
        for batch in batches:
            for at in range(len(batch)):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                yield row | {"part": row["part"].replace(SPACE, MARK).replace(" ", SPACE)}

    parts = written(texts.mapInArrow(cut, "key string, k int, n int, part string").repartition("key", "k"), "chunks")

    def bounds(seg, k, n, part):
        lead = 0 if k == 0 else 1
        start = 0 if k == 0 else seg.border(part, lead)
        end = len(part) if k == n - 1 else seg.border(part, lead + chunk)
        return start, max(start, end)

    def matrices(batches):
        seg = segmenter(shared.value)
        for row in chunks(batches):
            key, k, n, part = row["key"], row["k"], row["n"], row["part"]
            start, end = bounds(seg, k, n, part)
            snapped = k == 0 or (start > 0 and seg.forced(part, start))
            cells: dict = {}
            for i in range(1 if snapped else seg.longest):
                found = [p for p in seg.chunk_paths(part, start, end, {i: 0}) if k < n - 1 or p[0] == 0]
                cells[i] = {j: s for j, s, _, _ in found}
            # between two forced breaks there is one path, whatever stands before: it needs no second look
            ids = np.array(found[0][3], "<i4") if cells.keys() == {0} and cells[0].keys() == {0} else None
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([_packed(cells)]), _id_lists([ids])], ["key", "k", "matrix", "ids"])

    done = written(parts.mapInArrow(matrices, "key string, k int, matrix string, ids array<int>"), "matrices")
    entries = scan_entries(done).join(done.where("ids IS NULL").select("key", "k"), ["key", "k"], "left_semi")

    def backtrace(batches):
        seg = segmenter(shared.value)
        for row in chunks(batches):
            key, k, n, part = row["key"], row["k"], row["n"], row["part"]
            start, end = bounds(seg, k, n, part)
            states = {0: 0} if row["before"] is None else _unpacked(row["before"])[0]
            for j, _, i, ids in seg.chunk_paths(part, start, end, states):
                if k < n - 1 or not j:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), _id_lists([np.array(ids, "<i4")])], ["key", "k", "i", "j", "ids"])

    closed = done.where("ids IS NOT NULL").select("key", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), "ids")
    open_paths = parts.join(entries, ["key", "k"]).mapInArrow(backtrace, "key string, k int, i int, j int, ids array<int>")
    paths = written(closed.unionByName(open_paths), "paths")
    drop_written(parts)
    drop_written(done)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        back = {(k, j): i for k, i, j in zip(pdf["k"], pdf["i"], pdf["j"])}
        at, out = 0, []
        for k in range(pdf["k"].max(), -1, -1):
            out.append((pdf["key"].iloc[0], k, at))
            at = back[k, at]
        return pd.DataFrame(out, columns=["key", "k", "j"])

    chosen = paths.select("key", "k", "i", "j").groupBy("key").applyInPandas(chain, "key string, k int, j int")
    ordered = paths.join(chosen, ["key", "k", "j"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("all"))
    return ordered.select("key", F.flatten(F.col("all.ids")).alias("ids"))


def decode(encoded: DataFrame, model_file: str = MODEL_FILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep`` and text of (doc_id, ids); NULL ids give NULL."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_file))
    names = ["doc_id", *keep]

    def run(batches):
        seg = segmenter(shared.value)
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            valid = ids.is_valid().to_pylist()
            for lo in range(0, len(ids), 500):
                hi = min(lo + 500, len(ids))
                text = [seg.decode(flat[at[i] : at[i + 1]]) if valid[i] else None for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(text, pa.string())], [*names, "text"])

    rows = encoded.select(*dict.fromkeys([*names, "ids"]))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*names]) + ", text string")
