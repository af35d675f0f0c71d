"""Toxicity by lexicon induction: random walks over a word graph from labelled seeds.

Terms are words folded to lower case and truncated to a stem.  Edges of the graph are
positive pointwise mutual information of terms within a window, counted over all documents.
One walk restarts at seed terms that labelled rows show to be toxic, the other at all terms
as the clean rows have them; the ratio of a term's visits is its polarity weight.  A
document's evidence is the sum of its terms' positive weights; a monotone calibration on
labelled rows turns evidence into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import arrow, chunks, cut, ddl, id_remainder, offsets_of, small_batches, split_column, table, texts, tidy, utf8

FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Params:
    #: Bytes of a word that are its stem.
    stem: int = 6
    #: A graph term is in so many documents at least, however many there are.
    min_documents: int = 4
    #: ... and at most in this share, if a caller sets one.
    max_share: float = 1.0
    window: int = 8
    #: Labelled rows to learn from: the first by hash of doc_id, if there are more.
    max_labelled: int = 200_000
    #: A toxic seed's least z-score and log-odds ratio.
    seed_z: float = 3.5
    seed_log_odds: float = 1.5
    damping: float = 0.5
    steps: int = 40
    #: Share of a term's visits below which its change counts as none.
    tolerance: float = 1e-5
    #: Evidence per bin and number of bins of the calibration.
    bin_width: float = 0.25
    bins: int = 400
    threshold: float = 0.3


def terms(text: bytes, p: Params) -> list[bytes]:
    k = p.stem
    return [w[:k] for w in text.translate(FOLD).split()]


_TERMS = pa.schema([("term", pa.binary()), ("n", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])
_BINS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])
_TERMS_HELD = 1_000_000


def _split(texts: list[bytes], p: Params) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(stems of the distinct words, number of each word among them, offsets of the texts' words); stems may repeat."""
    words, index, offsets = split_column(pa.array([t.translate(FOLD) for t in texts], pa.large_binary()))
    return [w[: p.stem] for w in words.to_numpy(zero_copy_only=False).tolist()], index, offsets


def labelled_sample(labels: DataFrame, p: Params) -> DataFrame:
    """(doc_id, toxic): at most ``max_labelled`` rows with both known; of rows that repeat a doc_id, the largest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)


def _count_terms(docs: DataFrame, p: Params) -> DataFrame:
    """(term, n, toxic, clean): documents with the term, and labelled ones; of the empty term: all documents."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, np.zeros(3, np.int64)

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("term").aggregate([(c, "sum") for c in _TERMS.names[1:]]).rename_columns(_TERMS.names)

        for b in batches:
            labels = np.array([-1 if x is None else int(x > 0) for x in b.column("toxic").to_pylist()], np.int64)
            for first, part in chunks(texts(b.column("_text"))):
                stems, index, offsets = _split(part, p)
                own = labels[first : first + len(part)]
                whole += [len(part), (own == 1).sum(), (own == 0).sum()]
                names: dict[bytes, int] = {}
                at = np.array([names.setdefault(w, len(names)) for w in stems], np.int64)
                k = len(names)
                if not k:
                    continue
                code = np.unique(np.repeat(np.arange(len(part)), np.diff(offsets)) * k + at[index])
                owner, term = np.divmod(code, k)
                n = [np.bincount(term[mask], minlength=k) for mask in (slice(None), own[owner] == 1, own[owner] == 0)]
                held.append(pa.table([pa.array(names, pa.binary()), *map(pa.array, n)], schema=_TERMS))
                size += k
                if size > _TERMS_HELD:
                    held = [summed()]
                    size = len(held[0])
                    if 2 * size > _TERMS_HELD:
                        yield from held[0].cast(_TERMS).to_batches()
                        held, size = [], 0
        if held:
            yield from summed().cast(_TERMS).to_batches()
        yield arrow(_TERMS, term=[b""], n=[whole[0]], toxic=[whole[1]], clean=[whole[2]])

    got = docs.mapInArrow(tidy(fold), ddl(_TERMS)).where("n > 0")
    return got.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])


# pairs -----------------------------------------------------------------------------------

#: Pairs lie in square blocks of the terms' matrix, in its upper triangle: ``_SIDE`` by ``_SIDE`` terms.
_BITS = 11
_SIDE = 1 << _BITS
#: Pairs that a task sorts at once.
_PAIRS_HELD = 12_000_000
#: Tasks whose counts are added in one group; groups are added in turn.
_FAN_IN = 32
#: Sorted places in the block, as differences, and their counts; packed.
_BLOCKS = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("codes", pa.binary()), ("n", pa.binary())])
_VECTORS = pa.schema([("segment", pa.int64()), ("x", pa.binary())])


def _packed(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them all, compressed; planes of equal significance lie together."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(np.ascontiguousarray(x, f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def _unpacked(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(b[9:], decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}")[:, 0].astype(np.int64)


def _each(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, of which one is held beside it."""
    for i in range(len(b)):
        yield b.slice(i, 1).to_pylist()[0]


def _run_starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts; beside the places, only a byte a value is needed."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _block_rows(own: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """(block, packed places, packed counts) of the blocks of pairs ``own``, which are sorted in place.

    Blocks are packed one by one: beside the pairs, only one block's are held.
    """
    own.sort()
    out: tuple[list[int], list[bytes], list[bytes]] = ([], [], [])
    s = 0
    while s < len(own):
        block = int(own[s]) >> 2 * _BITS
        e = s + int(np.searchsorted(own[s:], (block + 1) << 2 * _BITS))
        first = _run_starts(own[s:e])
        code = own[s:e][first]
        code &= _SIDE * _SIDE - 1
        for held, x in zip(out, (block, _packed(np.diff(code, prepend=0)), _packed(np.diff(first, append=e - s)))):
            held.append(x)
        s = e
    return out


def _count_pairs(docs: DataFrame, vocabulary: dict[bytes, int], p: Params) -> DataFrame:
    """(block, part, codes, n): counts of graph terms within ``window`` words of each other, over all documents.

    One row per block that has pairs.  Tasks sort their pairs and send each block's once,
    packed; counts are added as dense blocks, by streams of rows, in groups of ``_FAN_IN`` tasks,
    then of as many groups, until one is left: no group grows with the number of tasks.
    """
    across = -(-len(vocabulary) // _SIDE)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    parts = docs.rdd.getNumPartitions()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, part = held.value.get, TaskContext.get().partitionId() // _FAN_IN
        buffer, used = np.empty(_PAIRS_HELD, np.int64), 0
        ids = np.arange(len(held.value) + 1)
        # the place of a pair: of its lesser term, plus of its greater
        lesser, greater = (ids >> _BITS) * across << 2 * _BITS | (ids & _SIDE - 1) << _BITS, ids >> _BITS << 2 * _BITS | ids & _SIDE - 1

        def rows() -> pa.RecordBatch:
            block, codes, n = _block_rows(buffer[:used])
            return arrow(_BLOCKS, block=block, part=[part] * len(block), codes=codes, n=n)

        for b in batches:
            for _, some in chunks(texts(b.column("_text"))):
                stems, index, offsets = _split(some, p)
                at = np.array([get(w, -1) for w in stems], np.int64)[index] if stems else np.zeros(0, np.int64)
                known = at >= 0
                ends = offsets_of(known)[offsets]
                x = np.full(ends[-1] + p.window * len(some), -1, np.int64)
                x[np.arange(ends[-1]) + p.window * np.repeat(np.arange(len(some)), np.diff(ends))] = at[known]
                first, second = lesser[x], greater[x]
                for d in range(1, p.window + 1):
                    a, c = x[:-d], x[d:]
                    ok = np.flatnonzero((a >= 0) & (c >= 0))
                    a, c = a[ok], c[ok]
                    code = np.where(a <= c, first[ok] + second[ok + d], first[ok + d] + second[ok])
                    done = 0
                    while done < len(code):
                        k = min(len(code) - done, _PAIRS_HELD - used)
                        buffer[used : used + k] = code[done : done + k]
                        used, done = used + k, done + k
                        if used == _PAIRS_HELD:
                            yield rows()
                            used = 0
        if used:
            yield rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(_SIDE * _SIDE, np.int64), None

        def row() -> pa.RecordBatch:
            code = np.flatnonzero(total)
            out = arrow(_BLOCKS, block=[key[0]], part=[key[1] // _FAN_IN], codes=[_packed(np.diff(code, prepend=0))], n=[_packed(total[code])])
            total[code] = 0
            return out

        for b in batches:
            for r in _each(b):
                if key is not None and key != (r["block"], r["part"]):
                    yield row()
                key = r["block"], r["part"]
                total[np.cumsum(_unpacked(r["codes"]))] += _unpacked(r["n"])
        if key is not None:
            yield row()

    got = docs.mapInArrow(tidy(fold), ddl(_BLOCKS))
    while True:
        got = got.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(tidy(add), ddl(_BLOCKS))
        if (parts := -(-parts // _FAN_IN)) <= 1:
            return got


@dataclass(frozen=True)
class Lexicon:
    weights: dict[bytes, float]
    #: Probability by bin of evidence.
    probability: np.ndarray


def _by_block(blocks: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[np.ndarray]], v: int, k: int) -> np.ndarray:
    """[term, k] sums over all pairs, both ways.

    ``f`` gets one term, the other and the count of pairs, and the place of the one in its segment, and
    gives the k sums of the segment's terms.  Tasks add their own sums, then segments are added.
    """
    across = -(-v // _SIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for r in _each(b):
                code, n = np.cumsum(_unpacked(r["codes"])), _unpacked(r["n"])
                bi, bj = divmod(r["block"], across)
                i, j = code >> _BITS, code & _SIDE - 1
                for one, other, at, there in ((bi, bj, i, j), (bj, bi, j, i)):
                    if one == other and at is j:  # a term beside itself is no second pair
                        off = i != j
                        at, there, n = at[off], there[off], n[off]
                    own = out.setdefault(one, np.zeros((k, _SIDE)))
                    for row, x in zip(own, f(at + one * _SIDE, there + other * _SIDE, n, at)):
                        row += x
        yield arrow(_VECTORS, segment=list(out), x=[x.astype(np.float32).tobytes() for x in out.values()])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t["x"].to_pylist())
        return pa.table([[key[0].as_py()], [total.tobytes()]], schema=_VECTORS)

    out = np.zeros((k, across * _SIDE))
    for r in blocks.mapInArrow(tidy(run), ddl(_VECTORS)).groupBy("segment").applyInArrow(add, ddl(_VECTORS)).collect():
        out[:, r.segment * _SIDE : (r.segment + 1) * _SIDE] = np.frombuffer(bytes(r.x)).reshape(k, _SIDE)
    return out[:, :v].T


def polarity(pairs: DataFrame, toxic_seeds: np.ndarray, clean_seeds: np.ndarray, p: Params) -> np.ndarray:
    """Log ratio of the visits of two random walks with restart over the PPMI graph.

    The graph stays in its blocks of counts; a pair's weight is computed when a step needs
    it.  The vectors alone are in the driver.  The walks end after ``steps``, or once a step
    changes no term's visits by more than ``tolerance`` of them.
    """
    v = len(toxic_seeds)
    sc = pairs.sparkSession.sparkContext
    pairs = cut(pairs)
    side = _by_block(pairs, lambda one, other, n, at: [np.bincount(at, n, _SIDE)], v, 1)[:, 0]
    logs = sc.broadcast((np.log(np.maximum(side, 1)), float(np.log(max(side.sum(), 1)))))

    def through(x: np.ndarray) -> np.ndarray:
        """The graph's matrix, which is symmetric, times the columns of ``x``."""
        held, k = sc.broadcast(np.ascontiguousarray(x.T)), x.shape[1]

        def product(one: np.ndarray, other: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
            own, total = logs.value
            small = np.arange(4096)
            log_n = np.log(np.maximum(small, 1))[n] if len(n) and n.max() < 4096 else np.log(n)
            w = log_n
            w -= own[one]
            w -= own[other]
            w += total
            np.maximum(w, 0, out=w)
            w *= n / (n + 5)  # little evidence, little weight
            return (np.bincount(at, w * y[other], _SIDE) for y in held.value)

        got = _by_block(pairs, product, v, k)
        held.destroy()
        return got

    out_of = through(np.ones((v, 1)))
    alone = out_of[:, 0] <= 0
    seeds = np.stack([toxic_seeds, clean_seeds], 1)
    x = seeds
    for _ in range(p.steps):
        new = p.damping * (through(x / np.where(alone[:, None], 1, out_of)) + x[alone].sum(0) * seeds) + (1 - p.damping) * seeds
        settled = (np.abs(new - x) <= p.tolerance * (x + 1e-9)).all()
        x = new
        if settled:
            break
    return np.log((x[:, 0] + 1e-9) / (x[:, 1] + 1e-9))


def evidence(texts: list[bytes], weights: dict[bytes, float], p: Params) -> np.ndarray:
    """The sum of its terms' weights, of each text."""
    stems, index, offsets = _split(texts, p)
    get = weights.get
    own = np.array([get(w, 0.0) for w in stems])[index] if stems else np.zeros(0)
    return np.add.reduceat(np.append(own, 0.0), offsets[:-1]) * (np.diff(offsets) > 0)


def monotone(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Non-decreasing probabilities of bins (pool adjacent violators), each smoothed by one row at the mean rate."""
    rate = (toxic.sum() + 0.5) / (clean.sum() + toxic.sum() + 1)
    blocks: list[list[float]] = []
    for c, t in zip(clean, toxic):
        blocks.append([t, c + t, 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-12) >= blocks[-1][0] * max(blocks[-2][1], 1e-12):
            t_, n_, k_ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t_, blocks[-1][1] + n_, blocks[-1][2] + k_]
    return np.concatenate([np.full(int(k), (t + rate) / (n + 1)) for t, n, k in blocks])


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Lexicon:
    """Learns from ``labels`` (doc_id, toxic; already without rows held out) and the text of all ``docs``.

    Without toxic and clean labelled rows, or without seeds, no term has a weight, and
    every document gets the smoothed share of toxic rows.
    """
    sample = cut(labelled_sample(labels, p))
    marked = docs.select("doc_id", utf8(F.col("text")).alias("_text")).join(F.broadcast(sample), "doc_id", "left").select("_text", "toxic")
    counted = cut(_count_terms(marked, p))
    all_ = counted.where(F.length("term") == 0).first()
    n, a_all, b_all = (all_.n, all_.toxic, all_.clean) if all_ else (0, 0, 0)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (a_all + 1 - a)) - F.log(b / (b_all + 1 - b))
    usable = counted.where((F.length("term") > 0) & (F.col("n") >= p.min_documents) & (F.col("n") <= p.max_share * n))
    rated = usable.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b))
    weights: dict[bytes, float] = {}
    if a_all and b_all:
        # the most frequent first: their pairs lie in few, dense blocks
        nodes = rated.select("term", "n", "toxic", "clean", "odds", "z").toPandas().sort_values(["n", "term"], ascending=[False, True], ignore_index=True)
        a, b, odds, z = (nodes[c].to_numpy(np.float64) for c in ("toxic", "clean", "odds", "z"))
        seeds = np.where((z >= p.seed_z) & (odds >= p.seed_log_odds), a, 0.0)
        if seeds.any():
            vocabulary = {bytes(w): i for i, w in enumerate(nodes["term"])}
            pairs = _count_pairs(docs.select(utf8(F.col("text")).alias("_text")), vocabulary, p)
            score = polarity(pairs, seeds / seeds.sum(), (b + 0.5) / (b + 0.5).sum(), p)
            # a walk alone is no evidence against what labelled rows say of a term
            score = np.where((odds <= 0) & (a + b >= 20), 0.0, score)
            weights = {w: float(s) for w, s in zip(vocabulary, score) if s > 1.0}
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for x in batches:
            labels = x.column("toxic").to_pylist()
            for first, part in chunks(texts(x.column("_text"))):
                for e, label in zip(evidence(part, held.value, p).tolist(), labels[first:]):
                    seen[min(p.bins - 1, int(e / p.bin_width)), int(label > 0)] += 1
        yield arrow(_BINS, i=[i for i, _ in seen], j=[j for _, j in seen], n=list(seen.values()))

    bins = np.zeros((2, p.bins))
    for r in marked.where(F.col("toxic").isNotNull()).mapInArrow(tidy(fold), ddl(_BINS)).groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        bins[r.j, r.i] = r.n
    return Lexicon(weights, monotone(bins[0], bins[1]))


def score(docs: DataFrame, lexicon: Lexicon, p: Params = Params(), keep: tuple[Column, ...] | None = None) -> DataFrame:
    """(*keep, evidence, score, predicted) for whole texts; ``keep`` is doc_id alone if not given.

    Null and empty texts have no evidence and the score of such rows.  Repeated rows are
    each scored.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    source = docs.select(*(keep or (F.col("doc_id"),)), utf8(F.col("text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for b in batches:
            parts = [evidence(part, lex.weights, p) for _, part in chunks(texts(b.column("_text")))]
            e = np.concatenate([np.zeros(0), *parts])
            s = lex.probability[np.minimum(p.bins - 1, (e / p.bin_width).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(e), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], names=[*b.schema.names[:-1], "evidence", "score", "predicted"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(tidy(run), f"{fields}, evidence double, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return score(docs, lexicon, p, (row,)).where("predicted = 0").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = fit(docs, labels.where(id_remainder(F.col("doc_id"), 4) != 2))
    return score(docs, lexicon, keep=(F.col("doc_id"), (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out")))
