"""Vector best-fit packing of tokenised documents into sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared
segment lengths).  Items come in decreasing length; of the open bins that satisfy every
constraint, the one with the least weighted norm of what would remain, or the greatest
weighted dot product of item and remainder, takes the item.

Only lengths travel: items that fill a bin alone need no search, the others are dealt
evenly into shards of bounded size that pack independently.  A shard wastes at most part of
a bin, so the share lost is about one bin in its thousands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import tokens
from assaykit.llm.common import chunks, cut, table, texts, tidy, utf8


@dataclass(frozen=True)
class Params:
    tokenizer: str = field(default_factory=lambda: tokens.path("word_bpe_49k.json"))
    #: Capacities of a sequence; None: as much as the tokens allow.
    max_tokens: int = 2048
    max_documents: int | None = None
    max_attention: int | None = None
    #: Weights of (tokens, documents, attention) in the choice of a bin.
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"
    end_id: int = 0
    #: Mean number of items packed by one task.
    shard: int = 32_768

    def __post_init__(self) -> None:
        if self.rule not in ("norm", "dot"):
            raise ValueError("rule must be norm or dot")
        if self.max_documents is not None and self.max_documents < 1 or self.max_attention is not None and self.max_attention < self.max_tokens**2:
            raise ValueError("a full sequence must fit: max_documents 1, max_attention max_tokens ** 2 at least")


def vector_best_fit(lengths: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each item; ties go to the first bin."""
    caps = np.array([p.max_tokens, p.max_documents or p.max_tokens, p.max_attention or p.max_tokens**2], np.float64)
    weights = np.array(p.weights)
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    left, name = np.empty((3, max(64, n))), np.empty(max(64, n), np.int64)
    open_, made = 0, 0
    for i in order.tolist():
        l = int(lengths[i])
        item = np.array([l, 1.0, l * l])
        at = -1
        if open_:
            rest = left[:, :open_] - item[:, None]
            fits = (rest >= 0).all(0)
            if fits.any():
                if p.rule == "norm":
                    value = weights @ (rest / caps[:, None]) ** 2
                    at = int(np.where(fits, value, np.inf).argmin())
                else:
                    value = (weights * item / caps**2) @ left[:, :open_]
                    at = int(np.where(fits, value, -np.inf).argmax())
        if at < 0:
            at, open_ = open_, open_ + 1
            left[:, at], name[at] = caps, made
            made += 1
        bins[i], offsets[i] = name[at], p.max_tokens - left[0, at]
        left[:, at] -= item
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:  # nothing fits any more
            open_ -= 1
            left[:, at], name[at] = left[:, open_], name[open_]
    return bins, offsets


def pieces(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, uid, piece, start, length, ids_crc32): documents tokenised, only overlong ones cut.

    Every row of ``docs`` has the end id, so null and empty texts are one piece of one
    token.  uid numbers the rows, so that equal rows stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = tokens.word_bpe(p.tokenizer), p.end_id.to_bytes(4, "little")
        uid = (TaskContext.get().partitionId() << 33) - 1
        step = 4 * p.max_tokens
        for b in batches:
            row, out = [], []
            i = -1
            for _, part in chunks(texts(b.column("_text"))):
                for ids in bpe.encode(part):
                    ids += end
                    i += 1
                    uid += 1
                    for piece, at in enumerate(range(0, len(ids), step)):
                        own = ids[at : at + step]
                        row.append(i)
                        out.append((uid, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            cols = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])],
                names=["doc_id", "uid", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("_text")).mapInArrow(tidy(run, tokenizes=True), f"doc_id {kind}, uid long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, p: Params = Params()) -> DataFrame:
    """``items`` (any columns, with distinct (uid, piece), and length from 1 to max_tokens) with sequence_id and offset.

    Sequences are filled gaplessly from 0.  Items that fill a sequence alone get negative
    sequence ids.  No items: no rows.
    """
    items = cut(items)
    rest = items.where(F.col("length") < p.max_tokens)
    shards = max(1, -(-rest.count() // p.shard))
    alone = items.where(F.col("length") >= p.max_tokens).withColumns(
        {"sequence_id": -F.monotonically_increasing_id() - 1, "offset": F.lit(0).cast("long")}
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "piece"], ignore_index=True)
        bins, offsets = vector_best_fit(pdf["length"].to_numpy(), p)
        return pdf.drop(columns="_shard").assign(sequence_id=(key[0] << 32) + bins, offset=offsets)

    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64("uid", "piece"), F.lit(shards)))
    packed = dealt.groupBy("_shard").applyInPandas(run, alone.schema)
    return packed.unionByName(alone)


def best_fit_packing(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row per piece of each row of ``docs``.

    Only doc_id and text of ``docs`` are read; see ``pieces`` for nulls, empty texts and
    repeated rows.
    """
    return pack(pieces(docs, p), p).drop("uid")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
