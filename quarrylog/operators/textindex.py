"""String keys: exact get, prefix search, prefix counts, trie nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def exact_get(df: DataFrame, word: str, value: str, at: str) -> DataFrame:
    """Latest value of one word (the highest wins)."""
    return df.where(F.col(word) == at).groupBy(word).agg(F.max(value).alias("value"))


def prefix_search(df: DataFrame, word: str, prefix: str) -> DataFrame:
    """Distinct words with a prefix; reaches the scan as StringStartsWith."""
    return df.where(F.col(word).startswith(prefix)).select(word).distinct()


def prefix_rollup(df: DataFrame, word: str, max_depth: int | None = None) -> DataFrame:
    """Trie nodes: every prefix with its number of distinct words and whether it is a word.

    Words are made distinct first, and the explode feeds a map-side combining aggregate. ``max_depth``
    bounds the rollup for long strings; deeper prefixes are answered by ``prefix_search``. NULL words go."""
    words = df.where(F.col(word).isNotNull()).select(F.col(word).alias("word")).distinct()
    depth = F.length("word") if max_depth is None else F.least(F.length("word"), F.lit(max_depth))
    nodes = words.select("word", F.explode(F.sequence(F.lit(0), depth)).alias("n")).select("word", F.expr("substring(word, 1, n)").alias("prefix"))
    return nodes.groupBy("prefix").agg(F.count("*").alias("subtree_terminals"), F.max((F.col("prefix") == F.col("word")).cast("int")).alias("is_terminal"))


def prefix_counts(df: DataFrame, word: str, prefixes: list[str], max_depth: int | None = None) -> DataFrame:
    """Distinct words under each asked prefix, zeros kept, by equality with the rollup (no range join)."""
    asked = df.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    deep = max((len(p) for p in prefixes), default=0)
    nodes = prefix_rollup(df, word, deep if max_depth is None else max(deep, max_depth))
    return asked.join(nodes, "prefix", "left").select("prefix", F.coalesce("subtree_terminals", F.lit(0)).alias("words"))


def children(df: DataFrame, word: str) -> DataFrame:
    """Sorted distinct next characters of every prefix that has any."""
    words = df.where(F.col(word).isNotNull()).select(F.col(word).alias("word")).distinct().where(F.length("word") > 0)
    edges = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("n")).select(
        F.expr("substring(word, 1, n)").alias("prefix"), F.expr("substring(word, n + 1, 1)").alias("edge")
    )
    return edges.distinct().groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list("edge")), "").alias("edges"), F.count("*").alias("child_count"))


def adjust_counts(rollup: DataFrame, changes: DataFrame) -> DataFrame:
    """Incremental T10: ``changes(word, delta)`` with +1 for an added and -1 for a removed word; nodes that
    reach zero go (T9)."""
    steps = changes.select("word", "delta", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("n")).select(
        F.expr("substring(word, 1, n)").alias("prefix"), F.col("delta").cast("bigint").alias("subtree_terminals"), F.when(F.col("n") == F.length("word"), F.col("delta")).otherwise(0).cast("int").alias("is_terminal")
    )
    both = rollup.select("prefix", "subtree_terminals", F.col("is_terminal").cast("int")).unionByName(steps)
    return both.groupBy("prefix").agg(F.sum("subtree_terminals").alias("subtree_terminals"), F.sum("is_terminal").cast("int").alias("is_terminal")).where("subtree_terminals > 0")
