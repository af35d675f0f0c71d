"""Scores of predicted tags against gold tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.lexicon import ENTITY_TYPES
from assaykit.operators.iob import chunks

_SPAN = ["doc_id", "sent_id", "type", "start", "end"]


def _rates(correct: Column, gold: Column, predicted: Column) -> list[Column]:
    precision, recall = F.coalesce(F.try_divide(correct, predicted), F.lit(0.0)), F.coalesce(F.try_divide(correct, gold), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [(100 * x).alias(n) for x, n in ((precision, "precision"), (recall, "recall"), (f1, "f1"))]


def accuracy(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(accuracy): percentage of tokens with the gold tag."""
    keys = ["doc_id", "sent_id", "pos"]
    both = gold.select(*keys, F.col("tag").alias("_gold")).join(predicted.select(*keys, "tag"), keys)
    return both.agg((100 * F.avg((F.col("_gold") == F.col("tag")).cast("int"))).alias("accuracy"))


def _sides(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Distinct chunks with whether each side has them."""
    both = chunks(gold).withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(chunks(predicted).withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
    return both.groupBy(*_SPAN).agg(F.max("g").alias("g"), F.max("p").alias("p"))


def chunk_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(correct, gold, predicted, precision, recall, f1) over all chunks, in percent; 0 where nothing is there."""
    n = _sides(gold, predicted).agg(
        F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("correct"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold"), F.coalesce(F.sum("p"), F.lit(0)).alias("predicted")
    )
    return n.select("*", *_rates(F.col("correct"), F.col("gold"), F.col("predicted")))


def chunk_scores_by_type(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same for each of the nine types."""
    types = gold.sparkSession.createDataFrame([(t,) for t in ENTITY_TYPES], "type string")
    n = _sides(gold, predicted).groupBy("type").agg(F.sum(F.col("g") * F.col("p")).alias("correct"), F.sum("g").alias("gold"), F.sum("p").alias("predicted"))
    n = types.join(n, "type", "left").na.fill(0)
    return n.select("*", *_rates(F.col("correct"), F.col("gold"), F.col("predicted")))


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(type, correct, gold, predicted) of each batch of sentences with the tags of both sides."""
    for b in batches:
        sides = []
        for side in ("_g", "_p"):
            n = pc.fill_null(pc.list_value_length(b.column(side)), 0).to_numpy(zero_copy_only=False)
            tags = b.column(side).flatten().dictionary_encode()
            names = tags.dictionary.to_pylist()
            # O, whatever it is called, has no type
            kinds = [None if t == "O" else t.rpartition("-")[2] for t in names]
            code = np.array([ENTITY_TYPES.index(k) if k in ENTITY_TYPES else -1 for k in kinds] or [-1])
            begins = np.array([t.split("-")[0] == "B" for t in names] or [False])
            at = tags.indices.to_numpy(zero_copy_only=False)
            types, first = code[at], np.zeros(len(at), bool)
            first[(np.cumsum(n) - n)[n > 0]] = True
            cut = np.flatnonzero(first | (types < 0) | begins[at] | (types != np.roll(types, 1)))
            stop = np.zeros(len(at), np.int64)
            stop[cut] = np.append(cut[1:], len(at))
            stop[types < 0] = 0
            sides.append((n, types, stop))  # stop: of a chunk that starts there
        (n, gold, to), (m, predicted, till) = sides
        if not np.array_equal(n, m):
            raise ValueError("the sides of a sentence have tags of different number")
        count = lambda types, here: np.bincount(types[here], minlength=len(ENTITY_TYPES))
        both = (to > 0) & (to == till) & (gold == predicted)
        yield pa.RecordBatch.from_arrays([pa.array(ENTITY_TYPES), *[pa.array(x, pa.int64()) for x in (count(gold, both), count(gold, to > 0), count(predicted, till > 0))]], names=["type", "correct", "gold", "predicted"])


def _counted(sentences: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(type, correct, gold, predicted) of each type's chunks: the sides of a row are compared in it, so nothing is shuffled."""
    one = sentences.select(F.col(gold).alias("_g"), F.col(predicted).alias("_p")).mapInArrow(_chunk_batches, "type string, correct long, gold long, predicted long")
    return one.groupBy("type").agg(*[F.sum(x).alias(x) for x in ("correct", "gold", "predicted")])


def sentence_scores(sentences: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """``chunk_scores`` of rows that are sentences, with the tags of both sides as arrays; types are the nine."""
    n = _counted(sentences, gold, predicted).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("correct", "gold", "predicted")])
    return n.select("*", *_rates(F.col("correct"), F.col("gold"), F.col("predicted")))


def sentence_scores_by_type(sentences: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """The same for each of the nine types."""
    types = sentences.sparkSession.createDataFrame([(t,) for t in ENTITY_TYPES], "type string")
    n = types.join(_counted(sentences, gold, predicted), "type", "left").na.fill(0)
    return n.select("*", *_rates(F.col("correct"), F.col("gold"), F.col("predicted")))
