"""Phrases: pairs of words that stand together more often than chance."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators.lookup import lookup_join


def phrase_scores(sentences: DataFrame, tokens: str = "tokens", min_count: int = 5) -> DataFrame:
    """(a, b, n, score) of adjacent words: (n - min_count) * vocabulary / (n_a * n_b)."""
    # every token is the first of one pair, so counts of pairs give those of words: the text is read once
    pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.struct(F.get(tokens, i).alias("a"), F.get(tokens, i + 1).alias("b")))
    two = sentences.where(F.size(tokens) > 0).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    words = two.groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    size = words.count()
    often = words.where(F.col("n") >= min_count)  # a word is as frequent as its pairs
    a = often.select(F.col("w").alias("a"), F.col("n").alias("na"))
    b = often.select(F.col("w").alias("b"), F.col("n").alias("nb"))
    found = lookup_join(lookup_join(two.where(F.col("b").isNotNull() & (F.col("n") >= min_count)), a, "a", "inner"), b, "b", "inner")
    return found.select("a", "b", "n", ((F.col("n") - min_count) * size / (F.col("na") * F.col("nb"))).alias("score"))


def learn_phrases(sentences: DataFrame, tokens: str = "tokens", min_count: int = 5, threshold: float = 10.0, max_phrases: int = 100_000) -> Column:
    """The best phrases as a literal array for ``functions.text.merge_phrases``; at most ``max_phrases``, the model's size."""
    best = phrase_scores(sentences, tokens, min_count).where(F.col("score") > threshold).orderBy(F.desc("score"), "a", "b").limit(max_phrases)
    return F.lit([f"{r.a}_{r.b}" for r in best.select("a", "b").collect()] or [""])


def merge_all(sentences: DataFrame, found: DataFrame, tokens: str = "tokens", reps: int = 2) -> DataFrame:
    """``sentences`` with adjacent tokens joined as by ``functions.text.merge_phrases``, for a table ``found`` (a, b) of any size.

    Every row is given the phrases that its runs of tokens spell.  Rows whose hashes are
    equal share them, which adds phrases to choose from and changes no result.
    """
    found = found.select("a", "b").persist()
    names = found.select(F.concat_ws("_", "a", "b").alias("_phrase")).distinct()
    # a longer run than a pair is a phrase only if a word of the phrase has the sign that joins
    longest = 2 if found.where(F.col("a").contains("_") | F.col("b").contains("_")).isEmpty() else 2**reps

    def runs(n: int) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.concat_ws("_", F.slice(tokens, i, n)))
        return F.when(F.size(tokens) >= n, own).otherwise(F.array().cast("array<string>"))

    spelled = F.array_distinct(F.concat(*[runs(n) for n in range(2, longest + 1)]))
    keyed = sentences.withColumn("_key", F.xxhash64(tokens))
    own = keyed.select("_key", F.explode(spelled).alias("_phrase")).join(names, "_phrase", "left_semi").groupBy("_key").agg(F.collect_set("_phrase").alias("_own"))
    joined = F.when(F.col("_own").isNull(), F.col(tokens)).otherwise(tx.merge_phrases(F.col(tokens), F.col("_own"), reps))
    return keyed.join(own, "_key", "left").withColumn(tokens, joined).drop("_key", "_own")


def prepare(phrase: Column, phrases: Column | None = None) -> Column:
    """A search phrase as tokens: tokenised, processed and merged."""
    tokens = tx.processed_tokens(tx.tokenize(phrase, keep_sentences=False))
    return tokens if phrases is None else tx.merge_phrases(tokens, phrases)
