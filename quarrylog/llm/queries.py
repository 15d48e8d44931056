"""Registered queries of the operators and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylog.llm import chat, decontam, langid, neardup, pii, shards, toxicity, unigram, vectors
from quarrylog.session import table


def op1_pii(spark, d):
    """Personal data in every whole text of documents, with words that disclose it."""
    return pii.report(table(spark, d, "documents"))


def op2_sentencepiece(spark, d):
    """Every whole text of documents encoded and decoded: digests of the ids and of the decoded text."""
    both = unigram.encode(table(spark, d, "documents"), decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.length("decoded").cast("bigint").alias("decoded_chars"),
    )


def op3_toxicity(spark, d):
    """Toxicity score of every whole text of documents, learned from labels outside the held-out fold."""
    return toxicity.detect(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_decontamination(spark, d):
    """Documents that hold a benchmark item, or a near copy of one, with the most similar window."""
    return decontam.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op5_embedding_near_dedup(spark, d):
    """Links and components of all embeddings: equal labels, cosine of 0.98 or more."""
    return vectors.near_duplicates(table(spark, d, "embeddings"))


def op6_sharding(spark, d):
    """All documents, appended in four arrivals by a hash of their ids, compacted after each, and read back from their shards."""
    return shards.report(table(spark, d, "documents")).drop("version")


def op7_chat_formatting(spark, d):
    """Budgeted windows of all conversations and of one made of control strings, read back."""
    return chat.report(chat.with_hostile(table(spark, d, "conversations")))


def op8_token_counts(spark, d):
    """Unigram token count of every whole text of documents."""
    return unigram.count_tokens(table(spark, d, "documents"))


def op9_language_id(spark, d):
    """Language of every whole text of documents."""
    return langid.detect(table(spark, d, "documents"))


def op10_minhash_near_dedup(spark, d):
    """Near-duplicate components of all documents: 2-word shingle sets of similarity 0.8 or more."""
    return neardup.near_duplicates(table(spark, d, "documents"), words=2, percent=80)


ORACLES: dict[str, str] = {
    "op6_sharding": """SELECT doc_id, CAST((instr('0123456789abcdef', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 1)) - 1) % 4 AS BIGINT) AS arrival,
 true AS settled, sha256(text) AS text_sha256 FROM documents""",
    "op4_decontamination": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') t FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') t FROM benchmark),
 bs AS (SELECT item_id, len(t) size, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) h FROM b WHERE len(t) >= 5),
 n AS (SELECT count(*) n FROM b WHERE len(t) > 0),
 wt AS (SELECT h, ln(1 + (SELECT n FROM n) / count(DISTINCT item_id)) weight FROM bs GROUP BY h),
 g AS (SELECT item_id, size, h, count(*) c FROM bs GROUP BY ALL),
 it AS (SELECT item_id, size, sum(weight * c) total FROM g JOIN wt USING (h) GROUP BY ALL),
 ds AS (SELECT doc_id, unnest(range(0, len(t) - 4)) pos, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) h FROM w WHERE len(t) >= 5),
 st AS (SELECT DISTINCT doc_id, item_id, size, pos AS start FROM ds JOIN g USING (h)),
 win AS (SELECT st.doc_id, st.item_id, st.size, st.start, ds.h, count(*) c FROM st JOIN ds ON ds.doc_id = st.doc_id AND ds.pos BETWEEN st.start AND st.start + st.size - 5 GROUP BY ALL),
 sim AS (SELECT win.doc_id, win.item_id, start, sum(CASE WHEN g.h IS NULL THEN 0 ELSE wt.weight * least(win.c, g.c) END) inter, sum(coalesce(wt.weight, ln(1 + (SELECT n FROM n))) * win.c) wsum
   FROM win LEFT JOIN g ON g.item_id = win.item_id AND g.h = win.h LEFT JOIN wt ON wt.h = win.h GROUP BY ALL),
 r AS (SELECT doc_id, item_id, start, round(inter / (total + wsum - inter), 6) s FROM sim JOIN it USING (item_id) WHERE inter / (total + wsum - inter) >= 0.8 - 1e-9)
 SELECT doc_id, item_id, max(s) AS similarity, arg_min(start, row(-s, start)) AS first_word FROM r GROUP BY ALL""",
    "op5_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings
   WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98e0),
 r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
 c AS (SELECT x, min(y) m FROM r GROUP BY x), n AS (SELECT x, count(*) k FROM l GROUP BY x)
 SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
 FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id""",
    "op7_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations
   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 t AS (SELECT *, len(regexp_extract_all(x, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, r, x) seq,
   length(x) + length(regexp_replace(x, '[^\\\[<]', '', 'g')) + CASE r WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(r) + length(regexp_replace(r, '[^\\\[<>]', '', 'g')) END size FROM c),
 u AS (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY seq) e FROM t),
 v AS (SELECT *, e - k s, (e - k) // 384 cell FROM u),
 o AS (SELECT *, e - min(s) OVER (PARTITION BY conv_id, cell) > 384 alone FROM v),
 p AS (SELECT *, CASE WHEN seq > 1 AND (cell <> lag(cell) OVER q OR alone <> lag(alone) OVER q) THEN 1 ELSE 0 END step FROM o WINDOW q AS (PARTITION BY conv_id ORDER BY seq)),
 w AS (SELECT *, sum(step) OVER (PARTITION BY conv_id ORDER BY seq) win FROM p),
 y AS (SELECT conv_id, min(seq) sys_seq, arg_min(win, seq) sys_win, arg_min(size, seq) sys_size FROM w WHERE r = 'system' GROUP BY conv_id),
 z AS (SELECT *, max(e) OVER (PARTITION BY conv_id, win) last_e, max(win) OVER (PARTITION BY conv_id) last_win FROM w)
 SELECT z.conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY seq)) AS turns_sha256,
   coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY seq) FILTER (r = 'assistant'), '')) AS loss_sha256,
   sum(size) + coalesce(sum(size) FILTER (win < last_win AND last_e - s <= 96 AND seq IS DISTINCT FROM sys_seq), 0) + coalesce(any_value(sys_size * (last_win - sys_win)), 0) AS formatted_chars,
   any_value(last_win) + 1 AS n_windows
 FROM z LEFT JOIN y ON y.conv_id = z.conv_id GROUP BY z.conv_id""",
    "op10_minhash_near_dedup": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') t FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN t ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END h FROM w),
 g AS (SELECT min(doc_id) doc_id, h, len(h) n FROM (SELECT doc_id, list_sort(h) h FROM s) WHERE len(h) > 0 GROUP BY h),
 e AS (SELECT doc_id, n, unnest(h) x FROM g), f AS (SELECT x, count(*) c FROM e GROUP BY x),
 o AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) r FROM e JOIN f USING (x)),
 p AS (SELECT * FROM o WHERE r <= n - ceil(0.8 * n) + 1),
 q AS (SELECT DISTINCT a.doc_id x, b.doc_id y FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
 k AS (SELECT q.x, q.y, len(list_intersect(a.h, b.h)) i, a.n + b.n t FROM q JOIN g a ON a.doc_id = q.x JOIN g b ON b.doc_id = q.y),
 l AS MATERIALIZED (SELECT x, y FROM k WHERE 100 * i >= 80 * (t - i) UNION ALL SELECT y, x FROM k WHERE 100 * i >= 80 * (t - i)),
 r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
 c AS (SELECT x, min(y) m FROM r GROUP BY x)
 SELECT s.doc_id, len(s.h) AS n_shingles, coalesce(least(g.doc_id, m), s.doc_id) AS component_id, s.doc_id = coalesce(least(g.doc_id, m), s.doc_id) AS kept
 FROM s LEFT JOIN g ON list_sort(s.h) = g.h LEFT JOIN c ON c.x = g.doc_id""",
}

QUERIES = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
