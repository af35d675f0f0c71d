"""Token ids in binary form, packed by best-fit-decreasing.

Documents are encoded with an end id each; overlong ones are cut into full pieces and a
rest, without loss.  Pieces are dealt into shards of bounded size by a hash of their place,
so a hot source or a huge document spreads evenly, and each shard is packed by
best-fit-decreasing: a segment tree over remaining capacities finds the fullest bin that
still takes a piece in logarithmic time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import tokens
from assaykit.llm.common import chunks, table, texts, tidy, utf8


@dataclass(frozen=True)
class Params:
    tokenizer: str = field(default_factory=lambda: tokens.path("byte_bpe_50k.tiktoken"))
    length: int = 2048
    #: Mean bytes of text packed by one task.
    shard_bytes: int = 24_000_000
    pad_id: int = 0


class CapacityTree:
    """Open bins by remaining capacity; ``take(n)`` removes one of the least capacity >= n."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, k: int) -> None:
        i = self.base + capacity
        while i:
            self.count[i] += k
            i >>= 1

    def put(self, bin_: int, capacity: int) -> None:
        self.bins[capacity].append(bin_)
        self._add(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        i, count = self.base + n, self.count
        if not count[i]:
            while True:  # climb until a right-hand sibling has bins, then go down leftmost
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.base:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.base
        self._add(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item of 1 to ``capacity``."""
    tree, made = CapacityTree(capacity), 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = sizes[i]
        if (got := tree.take(n)) is None:
            got, made = (made, capacity), made + 1
        b, left = got
        bins[i], offsets[i] = b, capacity - left
        if left > n:
            tree.put(b, left - n)
    return bins, offsets


_SCHEMA = "sequence_id long, doc_ids array<{id}>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, input_ids binary"


def packed_sequences(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per packed sequence of at most ``length`` tokens.

    doc_ids and pieces (the number of the piece in its document) in order of place;
    cu_seqlens: 0 and the end of every segment; position_resets: where positions start at
    0 again; input_ids: ``length`` little-endian 16-bit ids, the rest ``pad_id``
    (n_tokens is the number before it).  Null and empty texts are their end id alone.
    Repeated rows are packed each; other columns are not read.  No rows: no sequences.
    """
    width = p.length
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // p.shard_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.byte_bpe(p.tokenizer)
        if bpe.end > 0xFFFF:
            raise ValueError(f"ids up to {bpe.end} don't fit in 16 bits")
        place = TaskContext.get().partitionId() << 33
        end = np.array([bpe.end], np.uint16)
        for b in batches:
            ids = b.column("doc_id")
            for first, part in chunks(texts(b.column("_text"))):
                row, out = [], []
                for i, t in enumerate(part, first):
                    own = np.concatenate([bpe.encode(t).astype(np.uint16), end])
                    for piece, at in enumerate(range(0, len(own), width)):
                        cut = own[at : at + width]
                        row.append(i)
                        out.append((place, piece, len(cut), cut.tobytes()))
                        place += 1
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary())))],
                    names=["doc_id", "place", "piece", "n", "ids"],
                )

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        n = t["n"].to_numpy().astype(np.int64)
        bins, offsets = best_fit_decreasing(n, width)
        order = np.lexsort([offsets, bins])
        edge = np.flatnonzero(np.diff(bins[order], prepend=-1, append=-2))
        doc, piece, ids = t["doc_id"].to_pylist(), t["piece"].to_pylist(), t["ids"].to_pylist()
        rows = []
        for s, e in zip(edge, edge[1:]):
            own = order[s:e].tolist()
            joined = b"".join(ids[i] for i in own)
            ends = np.cumsum(n[own]).tolist()
            rows.append(((key[0].as_py() << 32) + int(bins[own[0]]), [doc[i] for i in own], [piece[i] for i in own], [0, *ends], [0, *ends[:-1]], ends[-1], joined + p.pad_id.to_bytes(2, "little") * (width - ends[-1])))
        names = ["sequence_id", "doc_ids", "pieces", "cu_seqlens", "position_resets", "n_tokens", "input_ids"]
        kinds = [pa.int64(), pa.list_(t.schema.field("doc_id").type), *[pa.list_(pa.int32())] * 3, pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    made = docs.select("doc_id", utf8(F.col("text")).alias("_text")).mapInArrow(tidy(encode), f"doc_id {kind}, place long, piece int, n int, ids binary")
    dealt = made.withColumn("_shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(pack, _SCHEMA.format(id=kind))


def write_binary(sequences: DataFrame, folder: str, p: Params = Params()) -> DataFrame:
    """Writes every partition as three raw files in ``folder``; returns (file, sequences, segments).

    ``<name>.ids``: the matrix [sequence, length] of little-endian 16-bit ids;
    ``<name>.cu``: 32-bit cumulative segment lengths of all sequences, one after the other;
    ``<name>.pos``: the matrix of 16-bit positions, which restart at 0 in every segment.
    A task writes under a name of its own attempt and then renames, so a task that is
    run again leaves one set of files.  ``folder`` must be shared by all executors.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base, name = Path(folder), f"part-{task.partitionId():05d}"
        base.mkdir(parents=True, exist_ok=True)
        drafts = [base / f".{name}.{task.taskAttemptId()}.{k}" for k in ("ids", "cu", "pos")]
        sequences = segments = 0
        with drafts[0].open("wb") as ids, drafts[1].open("wb") as cu, drafts[2].open("wb") as pos:
            for b in batches:
                for row, ends in zip(b.column("input_ids").to_pylist(), b.column("cu_seqlens").to_pylist()):
                    sequences, segments = sequences + 1, segments + len(ends) - 1
                    ids.write(row)
                    cu.write(np.array(ends, "<u4").tobytes())
                    runs = [*np.diff(ends), p.length - ends[-1]]
                    pos.write(np.concatenate([np.arange(k) for k in runs]).astype("<u2").tobytes())
        for d, k in zip(drafts, ("ids", "cu", "pos")):
            d.rename(base / f"{name}.{k}")
        yield pa.RecordBatch.from_pylist([{"file": name, "sequences": sequences, "segments": segments}], schema=pa.schema([("file", pa.string()), ("sequences", pa.int64()), ("segments", pa.int64())]))

    return sequences.select("input_ids", "cu_seqlens").mapInArrow(tidy(write), "file string, sequences long, segments long")


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents"))
