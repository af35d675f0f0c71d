"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one distributed count of (language, bucket); its result is bounded by
buckets x languages whatever the corpus, so the log-probability matrix can be broadcast.
Scoring gathers matrix entries for the n-grams of a block of documents and sums them per
document with ``reduceat``: no Python loop over n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import CHUNK_BYTES, arrow, chunks, ddl, id_remainder, table, texts, tidy, utf8

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    shortest: int = 1
    longest: int = 3
    #: Number of hash buckets: with ``max_languages`` the bound of the broadcast matrix.
    buckets: int = 1 << 15
    alpha: float = 0.5
    #: Languages learned: those of most documents, of equals the first by name.
    max_languages: int = 500


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(texts: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(starts, letters per text, a bucket array for each n).

    Every text is preceded by one blank, and all characters but letters become blanks, so
    n-grams are those of blank-padded words.  A position with no valid n-gram has the
    bucket ``p.buckets``.  Position ``starts[i]`` begins text i.
    """
    words = [t.decode("utf-8", "replace").lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    is_letter = _letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    last = len(codes) - 1
    mask = is_letter[:last]
    out = []
    for n in range(p.shortest, p.longest + 1):
        h = np.full(last, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        ok = np.zeros(last, bool)
        width = len(codes) - n + 1
        if width > 0:
            m = min(width, last)
            ok[:m] = True
            some = np.zeros(m, bool)
            for j in range(n):
                h[:m] = (h[:m] ^ codes[j : j + m]) * np.uint32(0x85EBCA6B + 2 * j)
                if 0 < j < n - 1:
                    ok[:m] &= is_letter[j : j + m]
                some |= is_letter[j : j + m]
            ok[:m] &= some
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out.append(np.where(ok, h % np.uint32(p.buckets), np.uint32(p.buckets)).astype(np.int64))
    return starts, np.add.reduceat(mask, starts, dtype=np.int64), out


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])


def count_ngrams(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(lang, bucket, n) over all rows with one of the ``max_languages`` most frequent languages; bucket -1 counts documents.

    Each task folds its rows into one dense array per language and emits non-zero entries
    once: no row per n-gram is ever shuffled.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for first, part in chunks(texts):
                own = langs[first : first + len(part)]
                for lang in set(own):
                    mine = [t for t, x in zip(part, own) if x == lang]
                    total = seen.setdefault(lang, np.zeros(p.buckets + 1, np.int64))
                    for h in features(mine, p)[2]:
                        total += np.bincount(h, minlength=p.buckets + 1)
                    rows[lang] = rows.get(lang, 0) + len(mine)
        for lang, total in seen.items():
            at = np.flatnonzero(total[:-1])
            yield arrow(_COUNTS, lang=[lang] * (len(at) + 1), bucket=np.append(at, -1), n=np.append(total[at], rows[lang]))

    docs = docs.where(F.col("lang").isNotNull())
    names = [r.lang for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.max_languages).collect()]
    had = docs.where(F.col("lang").isin(names)).select("lang", utf8(F.col("text")).alias("text"))
    return had.mapInArrow(tidy(fold), ddl(_COUNTS)).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: [language, bucket] log probabilities, with a last column of zeros for no n-gram.
    logp: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Learns from every row of ``docs`` whose lang is not null (see ``max_languages``).  No rows: no languages."""
    got = count_ngrams(docs, p)
    pdf = got.select("lang", F.col("bucket").cast("int"), "n").toPandas()
    names = tuple(sorted(pdf["lang"].unique()))
    counts, rows = np.zeros((len(names), p.buckets)), np.zeros(len(names))
    at = pdf["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
    bucket, n = pdf["bucket"].to_numpy(), pdf["n"].to_numpy()
    is_doc = bucket < 0
    rows[at[is_doc]] = n[is_doc]
    counts[at[~is_doc], bucket[~is_doc]] = n[~is_doc]
    logp = np.log(counts + p.alpha) - np.log(counts.sum(1, keepdims=True) + p.alpha * p.buckets)
    return Model(names, np.hstack([logp, np.zeros((len(names), 1))]), np.log(np.maximum(rows, 1) / max(rows.sum(), 1)))


def predict(texts: list[bytes], model: Model, p: Params) -> tuple[list[str], np.ndarray]:
    starts, letters, grams = features(texts, p)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    total = np.empty((len(model.languages), len(texts)))
    for i, row in enumerate(model.logp):
        total[i] = model.prior[i] + sum(np.add.reduceat(row[h], starts) for h in grams)
    best = total.argmax(0)
    top = total.max(0)
    score = 1 / np.exp(total - top).sum(0)
    known = letters > 0
    return [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known)], np.where(known, score, 0.0)


def identify(docs: DataFrame, model: Model, p: Params = Params(), keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score): the posterior's best language for whole texts.

    Null, empty and letterless texts are ``und`` with score 0.  Ties take the
    alphabetically first language.  Only ``doc_id`` and ``text`` of ``docs`` are read, so
    other columns may have any names; repeated rows are each scored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", *keep, utf8(F.col("text")).alias("_text"))
    carried = source.drop("_text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names: list[str] = []
            scores: list[np.ndarray] = []
            for _, part in chunks(texts(b.column("_text")), CHUNK_BYTES):
                n, s = predict(part, held.value, p)
                names += n
                scores.append(s)
            cols = [b.column(i) for i, name in enumerate(b.schema.names) if name != "_text"]
            keys = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*keys, "lang_pred", "score"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    return source.mapInArrow(tidy(score), f"{fields}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = fit(docs.where(~held_out))
    return identify(docs, model, keep=(held_out.alias("held_out"),))
