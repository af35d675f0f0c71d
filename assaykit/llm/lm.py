"""Log-likelihoods of whole documents under a gated recurrent language model.

All training documents are counted: the counts define the unigram base, the vocabulary,
the classes of the factored softmax and the distribution of words within shape classes.
Counts are used in three tiers, so that nothing that grows with the corpus is broadcast:

* the ``words`` most frequent words are symbols of the model;
* counts of the ``known_words`` most frequent are broadcast, a bounded table;
* other words of a document are rare; they alone are joined with the table of all counts.

The network is fitted on all training documents by rounds of local training: in each round
every shard continues from the same weights over its next share of documents, and the
shards' weights are averaged, weighted by tokens.  The number of shards grows with the
corpus up to ``max_shards``, then their size does; a shard is a stream, so a task's memory
is that of a window whatever its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import arrow, chunks, cut, ddl, id_remainder, keep_heap, offsets_of, split_column, table, texts, tidy, utf8
from assaykit.llm.gru import Gru, Shape

END = b""


@dataclass(frozen=True)
class Params:
    words: int = 4096
    shapes: int = 32
    classes: int = 64
    hidden: int = 32
    embedding: int = 24
    known_words: int = 200_000
    smoothing: float = 0.1
    #: Mean training tokens of a shard, and the most shards.
    shard_tokens: int = 4_000_000
    max_shards: int = 4096
    rounds: int = 2
    #: Documents longer than this come first in their shard, so that none goes on alone at its end.
    long_tokens: int = 2048
    #: Documents whose text makes up this many bytes are scored together.
    block_bytes: int = 8_000_000


_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
_SUMS = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())])
_PIECE = 8_192
_WORDS_HELD = 2_000_000


def tokens(text: bytes) -> list[bytes]:
    """Words and the end."""
    return [*text.lower().split(), END]


def shape_of(word: bytes, p: Params) -> int:
    """The class of a word outside the model's vocabulary: a hash of its last three bytes."""
    return zlib.crc32(word[-3:]) % p.shapes


def shapes_of(words: pa.Array, p: Params) -> np.ndarray:
    """``shape_of`` of each word of a binary column; only distinct ends are hashed."""
    ends = pc.binary_slice(words.cast(pa.binary()), -3).dictionary_encode()
    return np.array([shape_of(w, p) for w in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]


def _column(words) -> pa.Array:
    return pa.array(list(words), pa.large_binary())


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``split_words`` with the distinct words as a large binary column."""
    return split_column(pa.array([t.lower() for t in texts], pa.large_binary()))


def _merged(held: list[pa.Table]) -> pa.Table:
    """Sums of counts by word; grouping strings costs Arrow several times as much as coding them."""
    coded = pa.concat_arrays([c for t in held for c in t["word"].chunks]).dictionary_encode()
    n = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(n, coded.indices.to_numpy(), np.concatenate([t["n"].to_numpy() for t in held]))
    return pa.table({"word": coded.dictionary, "n": n})


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts; the empty word counts ends."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        for b in batches:
            for _, part in chunks(texts(b.column("_text")), 1 << 22):
                words, index, _ = _words(part)
                ends += len(part)
                n = np.bincount(index, minlength=len(words))
                some = pa.table({"word": words, "n": n})
                held.append(some.filter(pa.array(n > 0)))
                size += len(some)
                if size > _WORDS_HELD:
                    held = [_merged(held)]
                    size = len(held[0])
                    if 2 * size > _WORDS_HELD:
                        yield from held[0].cast(_COUNTS).to_batches()
                        held, size = [], 0
        if held:
            yield from _merged(held).cast(_COUNTS).to_batches()
        yield arrow(_COUNTS, word=[END], n=[ends])

    return docs.select(utf8(F.col("text")).alias("_text")).mapInArrow(tidy(fold), ddl(_COUNTS)).where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Unigram:
    """Bounded statistics of the training text."""

    tokens: int
    distinct: int
    #: Symbols of the model, the end first.
    symbols: dict[bytes, int]
    #: Counts of the most frequent words, the symbols among them.
    known: dict[bytes, int]
    #: Training tokens and distinct words of each shape class.
    shape_tokens: np.ndarray
    shape_distinct: np.ndarray

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([[self.known.get(w, 0) for w in self.symbols], self.shape_tokens])


def _statistics(counts: DataFrame, p: Params) -> Unigram:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    words = counts.where(F.length("word") > 0)
    # the least count, by eighths of a power of two, that at most known_words words reach
    sizes = words.groupBy(F.floor(8 * F.log2("n")).alias("bin")).agg(F.min("n").alias("least"), F.count("*").alias("k")).orderBy(F.desc("bin")).collect()
    least, held_words = 1 << 62, 0
    for r in sizes:
        if (held_words := held_words + r.k) > p.known_words:
            break
        least = r.least
    top = words.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    known = dict(zip(map(bytes, top["word"]), top["n"].astype(int)))
    ends = counts.where(F.length("word") == 0).first()
    symbols = {w: i for i, w in enumerate([END, *list(known)[: p.words - 1]])}
    known[END] = int(ends.n) if ends else 0
    held = counts.sparkSession.sparkContext.broadcast(list(symbols))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(p.shapes, np.int64), np.zeros(p.shapes, np.int64)
        known = _column(held.value)
        for b in batches:
            words = b.column("word").cast(pa.large_binary())
            other = pc.invert(pc.is_in(words, value_set=known))
            shape = shapes_of(words.filter(other), p)
            np.add.at(n, shape, b.column("n").filter(other).to_numpy())
            v += np.bincount(shape, minlength=p.shapes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.shapes)), pa.array(n), pa.array(v)], names=["shape", "n", "v"])

    n, v = np.zeros(p.shapes), np.zeros(p.shapes)
    for r in counts.mapInArrow(tidy(fold), "shape long, n long, v long").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["shape"]], v[r["shape"]] = r.n, r.v
    return Unigram(int(total.n or 0), int(total.v or 0), symbols, known, n, v)


def _places(u: Unigram) -> dict[bytes, int]:
    """Numbers of the known words, the symbols first, so that one lookup serves both."""
    out = dict(u.symbols)
    for w in u.known:
        out.setdefault(w, len(out))
    return out


def _by_place(u: Unigram, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, log10 of the smoothed count, and whether it was counted, of each numbered word."""
    words = list(_places(u))
    k = len(u.symbols)
    symbol = np.concatenate([np.arange(k), k + shapes_of(_column(words[k:]), p)])
    counts = np.array([u.known.get(w, 0) for w in words], np.float64)
    return symbol, np.log10(counts + p.smoothing), counts > 0


def _numbers(words: pa.Array, places: pa.Array, p: Params, base: int) -> np.ndarray:
    """Places of distinct words; a word without one has, negative, -1 less its shape's symbol."""
    at = pc.index_in(words, value_set=places)
    out, none = at.fill_null(0).to_numpy().astype(np.int64), at.is_null()
    out[none.to_numpy(zero_copy_only=False)] = -1 - base - shapes_of(words.filter(none), p)
    return out


def _placed(texts: list[bytes], places: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(place of each word of the texts, offsets of the texts' words, words that have none).

    Words are looked up as they come, which takes less than to code them first.  One without a place
    has that of its shape, after all others.  The first place is the end's, whose word is empty: so is
    what lies beside white space at a text's ends, which is no word.
    """
    column = pa.array([t.lower() for t in texts], pa.large_binary())
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(column), column.buffers()))
    words, offsets = split.values.view(pa.large_binary()), split.offsets.to_numpy().astype(np.int64)
    at = _numbers(words, places, p, len(places))
    none = np.flatnonzero(at < 0)
    at[none] = -1 - at[none]
    real = at != 0
    if not real.all():
        offsets, at = offsets_of(real)[offsets], at[real]
    return at, offsets, words.take(pa.array(none))


def _with_ends(x: np.ndarray, offsets: np.ndarray, end) -> np.ndarray:
    """Values of all texts' words with ``end`` after each text's."""
    last = offsets[1:] + np.arange(len(offsets) - 1)
    out, word = np.full(len(x) + len(last), end, x.dtype), np.ones(len(x) + len(last), bool)
    word[last] = False
    out[word] = x
    return out


def train(docs: DataFrame, uni: Unigram, p: Params = Params()) -> Gru:
    """The network after ``rounds`` of averaged local training on all rows of ``docs``, each in one round."""
    spark = docs.sparkSession
    model = Gru.start(uni.symbol_counts(), Shape(len(uni.symbols), p.shapes, p.classes, p.hidden, p.embedding))
    if not uni.tokens:
        return model
    shards = max(1, min(p.max_shards, round(uni.tokens / p.shard_tokens)))
    symbols = spark.sparkContext.broadcast(uni.symbols)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known = TaskContext.get().partitionId() << 33, _column(symbols.value)
        for b in batches:
            for _, part in chunks(texts(b.column("_text")), p.block_bytes):
                at, offsets, _ = _placed(part, known, p)
                ids = _with_ends(at.astype(np.uint16), offsets, 0).tobytes()
                ends = (2 * (offsets + np.arange(len(offsets)))).tolist()
                n = np.diff(offsets) + 1
                coded = [ids[s:e] for s, e in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(coded)) + place), pa.array(n <= p.long_tokens), pa.array(coded, pa.binary())], names=["place", "short", "ids"])
                place += len(coded)

    coded = docs.select(utf8(F.col("text")).alias("_text")).mapInArrow(tidy(encode), "place long, short boolean, ids binary")
    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")
    turn = F.pmod(F.xxhash64("place", F.lit(1)), F.lit(p.rounds)).cast("int")
    coded = cut(coded.withColumn("turn", turn).repartitionById(shards, shard).sortWithinPartitions("turn", "short", F.xxhash64("place")))
    expected = max(1, uni.tokens // shards // p.rounds)
    for number in range(p.rounds):
        held = spark.sparkContext.broadcast(model)

        def fit(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            def own() -> Iterator[np.ndarray]:
                for b in batches:
                    for x in texts(b.column("ids")):
                        yield np.frombuffer(x, np.uint16)

            keep_heap()
            source = own()
            first = next(source, None)
            if first is None:
                return
            fitted, n = held.value.train(chain([first], source), expected)
            flat, s = fitted.flat(), TaskContext.get().partitionId()
            cuts = [n * flat[i : i + _PIECE].astype(np.float64) for i in range(0, len(flat), _PIECE)]
            yield arrow(_SUMS, part=[s // 64] * len(cuts), piece=list(range(len(cuts))), tokens=[n] * len(cuts), weights=[c.tobytes() for c in cuts])

        def add(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by([("part", "ascending"), ("tokens", "ascending")])
            total = sum(np.frombuffer(x) for x in t["weights"].to_pylist())
            return pa.table({"part": [0], "piece": [key[0].as_py()], "tokens": [sum(t["tokens"].to_pylist())], "weights": [total.tobytes()]}, schema=_SUMS)

        # sums of 64 shards first: no group grows with their number
        some = coded.where(F.col("turn") == number).select("ids").mapInArrow(tidy(fit), ddl(_SUMS)).groupBy("piece", "part").applyInArrow(add, ddl(_SUMS))
        got = sorted(some.groupBy("piece").applyInArrow(add, ddl(_SUMS)).collect(), key=lambda r: r.piece)
        if got:
            model = model.with_flat(np.concatenate([np.frombuffer(bytes(r.weights)) / r.tokens for r in got]).astype(np.float32))
    return model


def score(docs: DataFrame, counts: DataFrame, uni: Unigram, model: Gru, p: Params = Params(), keep: tuple[Column, ...] | None = None) -> DataFrame:
    """(*keep, n_tokens, n_known, train_tokens, base_score, score): a row per row of ``docs``.

    Scores are log10 probabilities of the whole text, its end included; null and empty
    texts are an end alone.  A word outside the vocabulary has the model's probability of
    its shape class, times its smoothed share in the class; unseen words together have the
    smoothing of one.  With nothing to learn from, both scores are of the smoothing alone.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((uni, model))
    source = docs.select(*(keep or (F.col("doc_id"),)), utf8(F.col("text")).alias("_text"))
    extra = p.smoothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        u, m = held.value
        places, k = _column(_places(u)), len(u.symbols)
        symbol, log_count, seen = (np.concatenate([x, y]) for x, y in zip(_by_place(u, p), (k + np.arange(p.shapes), np.zeros(p.shapes), np.zeros(p.shapes, bool))))
        log_in = np.log10(u.shape_tokens + extra * (u.shape_distinct + 1))
        within = np.where(symbol >= k, log_count - log_in[np.maximum(symbol - k, 0)], 0.0)
        symbol = symbol.astype(np.int32)
        base_all = np.log10(u.tokens + extra * (u.distinct + 1))
        place = TaskContext.get().partitionId() << 33
        for b in batches:
            # texts of like length go together: else a few long ones step on alone in every block
            b = b.take(pa.array(np.argsort(pc.binary_length(b.column("_text")).to_numpy(zero_copy_only=False), kind="stable")))
            column = b.column("_text")
            for first, part_texts in chunks(texts(column), p.block_bytes):
                at, offsets, unknown = _placed(part_texts, places, p)
                ids = _with_ends(symbol[at], offsets, 0)
                starts = offsets[:-1] + np.arange(len(part_texts))
                n = np.diff(offsets) + 1
                base = np.add.reduceat(_with_ends(log_count[at], offsets, log_count[0]), starts) - base_all * n
                inside = np.add.reduceat(_with_ends(within[at], offsets, 0.0), starts)
                n_known = np.add.reduceat(_with_ends(seen[at], offsets, bool(seen[0])), starts, dtype=np.int64)
                logp = m.score(np.split(ids, starts[1:])) / np.log(10)
                # rare words of each text, once, with their number
                coded = unknown.dictionary_encode()
                words, index = coded.dictionary, coded.indices.to_numpy()
                owner = np.searchsorted(offsets, np.flatnonzero(at >= len(places)), "right") - 1
                code, times = np.unique(owner * len(words) + index, return_counts=True)
                bounds = pa.array(np.searchsorted(code, np.arange(len(n) + 1) * len(words)), pa.int32())
                rare = words.take(pa.array(code % max(1, len(words)))).cast(pa.binary())
                part = b.slice(first, len(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1], pa.array(np.arange(place, place + len(n))), pa.array(n), pa.array(n_known), pa.array(base), pa.array(inside + logp),
                        pa.ListArray.from_arrays(bounds, rare), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64())),
                    ],
                    names=[*part.schema.names[:-1], "_place", "n_tokens", "_known", "_base", "_model", "_rare", "_times"],
                )
                place += len(n)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    scored = cut(source.mapInArrow(tidy(run), f"{fields}, _place long, n_tokens long, _known long, _base double, _model double, _rare array<binary>, _times array<long>"))
    rare = scored.where(F.size("_rare") > 0).select("_place", F.explode(F.arrays_zip("_rare", "_times")).alias("w")).select("_place", F.col("w._rare").alias("word"), F.col("w._times").alias("k"))
    sums = (
        rare.join(counts, "word", "left")
        .groupBy("_place")
        .agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + extra)).alias("logs"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    out = scored.join(sums, "_place", "left")
    carried = [F.col(f"`{f.name}`") for f in source.schema.fields[:-1]]
    return out.select(
        *carried,
        "n_tokens",
        (F.col("_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(uni.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + logs).alias("base_score"),
        (F.col("_model") + logs).alias("score"),
    )


def fit_and_score(train_docs: DataFrame, docs: DataFrame, p: Params = Params(), keep: tuple[Column, ...] | None = None) -> DataFrame:
    """Learns from all rows of ``train_docs`` and scores all rows of ``docs``; see ``score``."""
    counts = cut(count_words(train_docs))
    uni = _statistics(counts, p)
    return score(docs, counts, uni, train(train_docs, uni, p), p, keep)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 10) == 0
    return fit_and_score(docs.where(~held_out), docs, keep=(F.col("doc_id"), held_out.alias("held_out")))
