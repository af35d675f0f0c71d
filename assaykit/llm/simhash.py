"""SimHash near-duplicates, linked through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each decoded to nearby
Golay codeword indices.  Of 6 differing bits over 3 segments, either two segments differ by
at most 2 bits each, so both share an index and the pair of indices is a shared 24-bit
key; or one segment is equal and the others differ by 3, so the equal segment is the key.
Every link is therefore found; candidates are verified by their differing bits.

Equal fingerprints are first folded into one row with their count, so copies never meet in
a bucket.  Buckets above ``block`` rows are split into pairs of blocks, each a group of its
own; a verified pair counts only in the first key that its two fingerprints share, so
neither pairs nor their duplicates are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import golay
from assaykit.llm.common import chunks, cut, offsets_of, small_batches, spread_join, table, texts, tidy, utf8
from assaykit.llm.components import connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


@dataclass(frozen=True)
class Params:
    #: The decoding guarantees every link up to 6 bits; a smaller number is allowed.
    max_bits: int = 6
    #: Rows of a bucket that meet in one group.
    block: int = 4096
    #: Fingerprints whose keys one task makes.
    fingerprints: int = 16_384
    #: Largest table of hot keys that is broadcast; beyond it the join shuffles.
    broadcast_keys: int = 500_000

    def __post_init__(self) -> None:
        if not 0 <= self.max_bits <= 6:
            raise ValueError("max_bits must be 0 to 6")


def fingerprint_many(texts: list[bytes]) -> np.ndarray:
    """Unsigned SimHash of each text's 2-word shingles; one word: of the word; none: zero."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = t.lower().split()
        before = len(hashes)
        if len(ws) == 1:
            hashes.append(digest(ws[0], 42))
        else:
            hashes += [digest(a + b" " + b, 42) for a, b in zip(ws, ws[1:])]
        counts[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, offsets_of(counts)[:-1][some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, keep: tuple[Column, ...] | None = None) -> DataFrame:
    """(*keep, fp): a row per row of ``docs``; fp is the fingerprint's bits as a signed long."""
    source = docs.select(*(keep or (F.col("doc_id"),)), utf8(F.col("text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint_many(part) for _, part in chunks(texts(b.column("_text")), 1 << 19)]
            fp = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(tidy(run), f"{fields}, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    fp = fp.view(np.uint64)
    return [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fp``, key) of all keys."""
    segments = _segments(fp)
    near = [golay.indices(s) for s in segments]
    at, keys = [], []
    for family, (a, b) in enumerate(PAIRS):
        both = (near[a][:, :, None] << 12 | near[b][:, None, :]).reshape(len(fp), -1)
        ok = ((near[a] >= 0)[:, :, None] & (near[b] >= 0)[:, None, :]).reshape(len(fp), -1)
        row, col = np.nonzero(ok)
        at.append(row)
        keys.append(family << 24 | both[row, col])
    for family, s in enumerate(segments, len(PAIRS)):
        at.append(np.arange(len(fp)))
        keys.append(family << 24 | s)
    return np.concatenate(at), np.concatenate(keys)


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first key, in the order of families and indices, that each two fingerprints share."""
    sx, sy = _segments(x), _segments(y)
    none = 1 << 20
    least = []
    for a, b in zip(map(golay.indices, sx), map(golay.indices, sy)):
        same = (a[:, :, None] == b[:, None, :]).any(2) & (a >= 0)
        least.append(np.where(same, a, none).min(1))
    out = np.full(len(x), -1, np.int64)
    for family, s in reversed(list(enumerate(zip(sx, sy), len(PAIRS)))):
        out = np.where(s[0] == s[1], family << 24 | s[0], out)
    for family, (a, b) in reversed(list(enumerate(PAIRS))):
        out = np.where((least[a] < none) & (least[b] < none), family << 24 | least[a] << 12 | least[b], out)
    return out


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, n = b.column("fp").to_numpy(), b.column("n").to_numpy()
        for s in range(0, len(fp), 4096):
            at, key = keys_of(fp[s : s + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[s : s + 4096][at]), pa.array(n[s : s + 4096][at])], names=["key", "fp", "n"])


def _link_groups(key: np.ndarray, group: np.ndarray, side: np.ndarray, fp: np.ndarray, n: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, documents it is linked with here, least fp that it is joined with here) of linked rows.

    ``group`` numbers the runs of equal buckets; ``side`` is -1, or the block in a pair of
    blocks, of which only rows of different sides meet.
    """
    total, parent = np.zeros(len(fp), np.int64), np.arange(len(fp))
    at = np.arange(len(fp))
    for d in range(1, len(fp)):
        at = at[: np.searchsorted(at, len(fp) - d)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        i, j = at, at + d
        near = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= max_bits) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[near], j[near]
        if not len(i):
            continue
        once = first_shared(fp[i], fp[j]) == key[i]
        np.add.at(total, i[once], n[j[once]])
        np.add.at(total, j[once], n[i[once]])
        while True:  # join the two trees of each link
            a, b = parent[i], parent[j]
            if (a == b).all():
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    joined = np.flatnonzero((total > 0) | (parent != np.arange(len(fp))))
    return fp[joined], total[joined], fp[parent[joined]]


def links(distinct: DataFrame, p: Params = Params()) -> DataFrame:
    """(fp, n, root) partial rows: documents linked to fp, and a fingerprint that it is joined with.

    ``distinct``: (fp, n) with one row per fingerprint and its number of documents.
    """
    # each fingerprint has some 80 keys: they are made by tasks of even size, however few bytes the fingerprints have
    distinct = distinct.repartition(max(1, -(-distinct.count() // p.fingerprints)), "fp")
    keyed = distinct.mapInArrow(tidy(_explode), "key long, fp long, n long")
    hot = cut(keyed.groupBy("key").count().where(F.col("count") > p.block).select("key", F.ceil(F.col("count") / p.block).cast("int").alias("blocks")))
    small = hot.count() <= p.broadcast_keys
    split = keyed.join(F.broadcast(hot) if small else hot, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = (
        split.withColumn("side", F.coalesce(mine, F.lit(-1)))
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select("key", F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"), "side", "fp", "n")
        .repartition("key", "b1", "b2")
        .sortWithinPartitions("key", "b1", "b2")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def found(rows: np.ndarray) -> pa.RecordBatch:
            key, b1, b2, side, fp, n = rows
            new = (np.diff(key) != 0) | (np.diff(b1) != 0) | (np.diff(b2) != 0)
            group = np.concatenate([[0], np.cumsum(new)])
            size = np.bincount(group)
            some = size[group] > 1
            side = np.where(b1 == b2, -1, side)
            got = _link_groups(key[some], group[some], side[some], fp[some], n[some], p.max_bits)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["fp", "n", "root"])

        for b in batches:
            rows = np.array([c.to_numpy().astype(np.int64) for c in b.columns])
            held = rows if held is None else np.concatenate([held, rows], axis=1)
            if not held.shape[1]:
                continue
            last = (held[:3] != held[:3, -1:]).any(0)
            whole = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if whole:
                yield found(held[:, :whole])
                held = held[:, whole:].copy()
        if held is not None and held.shape[1]:
            yield found(held)

    return met.mapInArrow(tidy(verify), "fp long, n long, root long")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, fp, n_near, component_id): one row per row of ``docs``.

    n_near counts the other rows whose fingerprint differs by at most ``max_bits``;
    component_id is the least doc_id reachable over such links, the row's own included.
    Texts without words (null, empty) all have fingerprint zero and are linked like any
    other.  Rows that repeat a doc_id count as rows of their own.  A null doc_id is never
    the least; a component of nothing else has a null component_id.  Only doc_id and text
    of ``docs`` are read.
    """
    fps = cut(fingerprints(docs))
    classes = cut(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    met = cut(links(classes.select("fp", "n"), p).groupBy("fp", "root").agg(F.sum("n").alias("n")))
    roots = connected_components(met.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    near = met.groupBy("fp").agg(F.sum("n").alias("others"))
    known = (
        classes.join(near, "fp", "left")
        .join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "n", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.coalesce("component", "fp").alias("root"))
    )
    known = cut(known)
    least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("times"))
    size = known.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    known = spread_join(known.drop("least"), least, "root", "times", size.k).select("fp", "n_near", "component_id", "n")
    return spread_join(fps, known, "fp", "n", size.n or 0).select("doc_id", "fp", "n_near", "component_id")


def dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with one row of each component left: that of the least doc_id.

    Texts without words are one component, as they have one fingerprint.  Of rows that
    repeat the least doc_id, the one of the least text stays (null before others), of equals that
    of the least other columns in their order.  Rows with a null doc_id go if their component has
    another; else one of each fingerprint stays, by the same rule.
    """
    near = cut(near_duplicates(docs, p).select("doc_id", "fp", "component_id"))
    firsts = near.groupBy("doc_id").agg(F.count("*").alias("times"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    firsts = cut(firsts.where("first").select("doc_id", "times"))
    # only rows of ids that repeat are compared; texts are sorted and copied for that
    alone, often = firsts.where("times = 1").select("doc_id"), firsts.where("times > 1").select("doc_id")
    often = F.broadcast(often) if often.count() <= p.broadcast_keys else often
    nameless = near.where(F.col("component_id").isNull()).select("fp").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rank = F.struct(F.col("text"), *[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes if c != "text"]).alias("_rank")
    own = F.min_by("_row", "_rank").alias("_row")
    once = docs.join(alone, "doc_id", "left_semi").select(row)
    named = docs.join(often, "doc_id", "left_semi").select("doc_id", row, rank).groupBy("doc_id").agg(own)
    rest = fingerprints(docs.where(F.col("doc_id").isNull()), (row, rank)).join(nameless, "fp", "left_semi").groupBy("fp").agg(own)
    return once.unionByName(named.select("_row")).unionByName(rest.select("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    got = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return got.select("doc_id", digits.alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")
