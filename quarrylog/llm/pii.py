"""PII (1): information-theoretic sanitisation, in DataFrame operations only.

Base detectors mark e-mail addresses, IPv4 addresses, payment cards and phone numbers. A document's marked values are
its protected entities. Words that give an entity away are found from the corpus: for a word t and an entity e,
co(t, e) counts the documents that have both, however far apart, df(t) all documents that have t, df(e) those that
have e, N all documents; t discloses log2(co / df(t)) - log2(df(e) / N) bits about e. All four count distinct ids, and
a word is one that stands outside the marked values. A word with at least ``MIN_CO`` such documents, a share co / df(t)
of ``MIN_SHARE``, ``MIN_BITS`` bits and at least ``MIN_CONTEXTS`` different passages (from the word to the value with
``CONTEXT_CHARS`` on either side; copies of one passage are one) is replaced wherever it stands: generalised, or removed
from ``REMOVE_SHARE`` on.

Pairs come from the marked texts whose entities can pass MIN_CO and MIN_BITS at all; a word is paired if it can still pass
MIN_SHARE, its documents among those texts being no more than df(t). Both reductions lose nothing. df is one explode of all
words that keeps candidates (broadcast if they are few, else joined), so no vocabulary of all texts is shuffled. Offsets
are code points, ends exclusive.
Possessive patterns and look-behinds keep every detector linear on long runs.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.llm.common import drop_written, written

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
#: Pattern and the cheap test that must hold before it is tried.
PATTERNS = {
    # a match starts where the last one ended or where a run of address characters starts
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    # a whole chain of digits with single separators, of 12 digits at least; a shorter one is no card
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+", lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
}
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

CONTEXT_CHARS = 64
TERM_CHARS = 4
MIN_CO = 3
MIN_CONTEXTS = 2
MIN_SHARE = 0.5
MIN_BITS = 4.0
REMOVE_SHARE = 0.9
BROADCAST_ROWS = 50_000
NO_ID = -(2**63)
ROUND = 1e-9


def _located(text: Column, pattern: Column, kind: str) -> Column:
    """All matches as spans: gaps and matches alternate, so their lengths add up to positions."""
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), add, lambda acc: acc["out"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _is(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def base_spans(text: Column) -> Column:
    """The base detectors' spans, by start, then kind."""
    parts = []
    for kind, (pattern, hint) in PATTERNS.items():
        spans = F.filter(_located(text, F.lit(pattern), kind), partial(_valid_span, kind))
        parts.append(F.when(hint(text), spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def mark(docs: DataFrame) -> DataFrame:
    """Adds _text (NULL read as empty) and _base to the rows."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    return rows.withColumn("_base", base_spans(F.col("_text")))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= TERM_CHARS)


def _outside(text: Column, spans: Column) -> Column:
    """The text with a space for every marked value."""

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(spans, start, add, lambda acc: F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))), " "))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def _few(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of the number of rows; a plain join beyond it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _bits(co: Column, df: Column, df_entity: Column, n: int) -> Column:
    return F.log2(co / df) - F.log2(df_entity / F.lit(n))


def _passage(text: Column, spans: Column, term: Column, entity: Column) -> Column:
    """The stretch of text that holds the first places of the word and the value, with its borders."""
    at = F.length(F.get(F.split(text, F.concat(F.lit(r"(?iu)(?<!\p{L})"), term, F.lit(r"(?!\p{L})")), 2), F.lit(0)))
    value = F.get(F.filter(spans, lambda s: _entity(s) == entity), F.lit(0))
    start = F.greatest(F.lit(0), F.least(at, value["start"]) - CONTEXT_CHARS)
    end = F.greatest(at + F.length(term), value["end"]) + CONTEXT_CHARS
    return F.substring(text, start + 1, end - start)


def candidates(marked: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, entity, co, df_entity) of words that may disclose an entity, by marked texts alone, and the places (_key,
    _row, entity) and (_key, _row, term) of such entities and of all words beside them. _row is a hash of the row's text."""
    ids = marked.select("_key", "_row", F.explode(F.array_distinct(F.transform("_base", _entity))).alias("entity")).distinct()
    df_entity = ids.groupBy("entity").agg(F.count_distinct("_key").alias("df_entity"))
    tied = (F.col("df_entity") >= MIN_CO) & (-F.log2(F.col("df_entity") / F.lit(n)) >= MIN_BITS - ROUND)
    entities = written(ids.join(_few(df_entity.where(tied)), "entity"), "pii-entities")
    texts = marked.join(_few(entities.select("_key", "_row").distinct()), ["_key", "_row"], "left_semi")
    words = texts.select("_key", "_row", F.explode(_words(_outside(F.col("_text"), F.col("_base")))).alias("term"))
    df_near = words.groupBy("term").agg(F.count_distinct("_key").alias("df_near")).where(F.col("df_near") >= MIN_CO)
    often = words.join(_few(df_near), "term")
    pairs = often.join(entities, ["_key", "_row"]).where(F.col("df_near") * MIN_SHARE <= F.col("df_entity"))
    together = pairs.groupBy("term", "entity", "df_entity", "df_near").agg(F.count_distinct("_key").alias("co"))
    over = (F.col("co") >= MIN_CO) & (F.col("co") >= F.col("df_near") * MIN_SHARE) & (_bits(F.col("co"), F.col("df_near"), F.col("df_entity"), n) >= MIN_BITS - ROUND)
    return together.where(over).select("term", "entity", "co", "df_entity"), entities, words


def disclosing_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, share, bits) of words over the thresholds, and the (_key, term) places of all candidates."""
    n = docs.select("_key").distinct().count()
    rows = mark(docs).select("_key", F.xxhash64("_text").alias("_row"), "_text", "_base")
    marked = written(rows.where(F.size("_base") > 0), "pii-marked")
    found, entities, near = candidates(marked, n)
    found = written(found, "pii-candidates")
    words = rows.select("_key", F.explode(_words(_outside(F.col("_text"), F.col("_base")))).alias("term"))
    places = written(words.join(_few(found.select("term").distinct()), "term"), "pii-places")
    df = places.groupBy("term").agg(F.count_distinct("_key").alias("df"))
    bits = _bits(F.col("co"), F.col("df"), F.col("df_entity"), n)
    over = found.join(df, "term").select("term", "entity", (F.col("co") / F.col("df")).alias("share"), bits.alias("bits"))
    over = written(over.where((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS)), "pii-over")
    # the passages of what is left
    held = near.join(_few(over.select("term", "entity")), "term").join(entities, ["_key", "_row", "entity"])
    held = held.select("_key", "_row", "term", "entity").distinct().join(marked, ["_key", "_row"])
    passages = held.select("term", "entity", F.xxhash64(_passage(F.col("_text"), F.col("_base"), F.col("term"), F.col("entity"))).alias("passage"))
    several = passages.groupBy("term", "entity").agg(F.count_distinct("passage").alias("passages")).where(F.col("passages") >= MIN_CONTEXTS)
    terms = over.join(several, ["term", "entity"]).groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits"))
    terms = written(terms, "pii-terms")
    for done in (marked, entities, found, over):
        drop_written(done)
    return terms, places


def _term_spans(text: Column, terms: Column) -> Column:
    def one(t: Column) -> Column:
        return _located(text, F.concat(F.lit(r"(?iu)(?<!\p{L})"), t["term"], F.lit(r"(?!\p{L})")), "term")

    return F.flatten(F.transform(terms, one))


def _replaced(text: Column, spans: Column, removed: Column) -> Column:
    """The text with spans replaced; overlapping ones count as one, named by the first."""

    def add(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "term", F.when(F.array_contains(removed, F.lower(s["value"])), "").otherwise("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, label)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    body = F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, body).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """All columns of docs, with ``base`` and ``spans`` (arrays of start, ord, end, kind, value) and ``sanitised``, which take
    the place of columns of these names; columns of any other name stay as they are.

    NULL texts have no spans and stay NULL in ``sanitised``; empty texts stay empty. Rows that share an id share the
    words they are searched for, but spans are found in each row's own text; rows without an id count as one
    document. Repeated rows stay."""
    found = _searched(docs)
    own = [c for c in docs.columns if c not in ("base", "spans", "sanitised")]
    return found.select(*[_held(docs, c).alias(c) for c in own], F.col("_base").alias("base"), F.col("_spans").alias("spans"), "sanitised")


def _held(docs: DataFrame, name: str) -> Column:
    """Where _searched() keeps a column of docs."""
    return F.col(name) if name in ("doc_id", "text") else F.col(f"user{docs.columns.index(name)}")


def _searched(docs: DataFrame) -> DataFrame:
    """doc_id, text, the other columns under numbers (so that no name clashes), _base, _spans and sanitised."""
    others = [F.col(f"`{c}`").alias(f"user{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", *others)
    docs = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)))
    terms, places = disclosing_terms(docs)
    by_doc = places.join(terms, "term").groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("term", "share"))).alias("_terms"))
    by_doc = written(by_doc, "pii-by-document")
    rows = mark(docs).join(_few(by_doc), "_key", "left")
    rows = rows.withColumn("_spans", F.when(F.col("_terms").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", _term_spans(F.col("_text"), F.col("_terms"))))))
    removed = F.coalesce(F.transform(F.filter("_terms", lambda t: t["share"] >= REMOVE_SHARE), lambda t: t["term"]), F.array().cast("array<string>"))
    rows = rows.withColumn("sanitised", F.when(F.col("text").isNotNull(), _replaced(F.col("_text"), F.col("_spans"), removed)))
    drop_written(places)
    drop_written(terms)
    return rows


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with counts and digests of what was found."""
    rows = sanitise(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", partial(_is, k))).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all their columns whatever their names, with sanitised texts; n_chars follows the text where it is a column."""
    rows = _searched(docs).select(*[F.col("sanitised").alias("text") if c == "text" else _held(docs, c).alias(c) for c in docs.columns])
    return rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else rows
