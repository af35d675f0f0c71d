"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all item words is built once on the driver and broadcast; documents
stream through it, tracking the longest suffix that is a factor of any item.  A span is a
match of at least ``min_length`` words, or one that covers a whole item shorter than that.

Before the automaton runs, a block of documents is reduced in numpy to its runs of words
whose neighbouring pairs all occur in items (a hashed bitmap, so no true pair is lost):
the interpreter only steps through those runs, with the same result.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import chunks, offsets_of, table, texts, tidy, utf8

#: Folds A-Z and turns every separator byte into a blank; byte positions are kept.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class Params:
    #: Matches of this many words are removed; whole items of fewer words too.
    min_length: int = 8
    #: Share of a document's words in spans above which the whole document goes.
    max_coverage: float = 0.5
    #: Items are put into automata of at most this many words: the bound of one broadcast.
    automaton_words: int = 2_000_000
    pair_bits: int = 22


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids."""

    min_length: int
    pair_bits: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Items whose prefixes end in a state; all items with the state's words: over its link subtree.
    ends: dict[int, set[str]] = field(default_factory=lambda: defaultdict(set))
    #: Whole items shorter than min_length, by the state of their words.
    whole: dict[int, set[str]] = field(default_factory=lambda: defaultdict(set))
    shortest: int = 1 << 30

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if (q := step[last].get(c)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        new = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], min_length: int = 8, pair_bits: int = 22) -> Automaton:
        a = cls(min_length, pair_bits)
        coded = []
        for item, ws in items:
            if ws:
                ids = [a.vocabulary.setdefault(w, len(a.vocabulary)) for w in ws]
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = a._extend(last, c)
                a.shortest = min(a.shortest, len(ids), min_length)
        pairs = np.zeros(1 << pair_bits, bool)
        for item, ids in coded:  # once no state is split any more
            v = 0
            for c in ids:
                v = a.step[v][c]
                a.ends[v].add(item)
            if len(ids) < min_length:
                a.whole[v].add(item)
            own = np.asarray(ids, np.int64)
            pairs[a.pair(own[:-1], own[1:])] = True
        a.pairs = pairs
        a._finish()
        return a

    def _finish(self) -> None:
        """Items of the states that windows of min_length words reach, and short items on each state's link path."""
        k, order = self.min_length, sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True)
        below: dict[int, set[str]] = defaultdict(set)
        self.items: dict[int, frozenset[str]] = {}
        for v in order:
            own = self.ends.get(v, set()) | below.pop(v, set())
            if self.length[self.link[v]] < k <= self.length[v]:
                self.items[v] = frozenset(own)
            elif self.length[v] > k or self.link[v] > 0:
                below[self.link[v]] |= own
        self.shorts: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.step)
        for v in reversed(order):
            mine = ((self.length[v], frozenset(self.whole[v])),) if v in self.whole else ()
            self.shorts[v] = mine + self.shorts[self.link[v]]
        #: The ancestor that holds exactly the last min_length words.
        self.window: list[int] = [0] * len(self.step)
        for v in reversed(order):
            if self.length[v] >= k:
                self.window[v] = v if self.length[self.link[v]] < k else self.window[self.link[v]]
        self.ends = self.whole = None

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 ^ b * 0x85EBCA77) >> 7 & (1 << self.pair_bits) - 1

    def longest(self, ids: list[int]) -> list[tuple[int, int]]:
        """(state, longest matching length) after each word; -1 is no item's word."""
        step, link, length, v, l, out = self.step, self.link, self.length, 0, 0, []
        for c in ids:
            while v and c not in step[v]:
                v = link[v]
                l = length[v]
            if (n := step[v].get(c)) is not None:
                v, l = n, l + 1
            else:
                v = l = 0
            out.append((v, l))
        return out

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """(merged half-open word spans, items) of each document."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
        if not self.vocabulary:
            return out
        get, least, k = self.vocabulary.get, self.shortest, self.min_length
        flat = [w for ws in docs for w in (*ws, b"")]  # a blank word ends each document
        ids = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        at = np.flatnonzero(joined)
        joined[at] = self.pairs[self.pair(ids[at], ids[at + 1])]
        edges = np.flatnonzero(np.concatenate([[True], ~joined, [True]]))  # run i: words edges[i] to edges[i + 1]
        keep = (np.diff(edges) >= least) & (ids[edges[:-1]] >= 0)
        starts = offsets_of(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
        owner = np.searchsorted(starts, edges[:-1][keep], "right") - 1
        for s, e, d in zip(edges[:-1][keep].tolist(), edges[1:][keep].tolist(), owner.tolist()):
            spans, items = out[d]
            base = s - int(starts[d])
            for i, (v, l) in enumerate(self.longest(ids[s:e].tolist())):
                if l >= k:
                    items |= self.items[self.window[v]]
                    _cover(spans, base + i + 1 - k, base + i + 1)
                for n, own in self.shorts[v]:
                    if n <= l:
                        items |= own
                        _cover(spans, base + i + 1 - n, base + i + 1)
        return out


def _cover(spans: list[tuple[int, int]], start: int, end: int) -> None:
    while spans and spans[-1][1] >= start:
        s, e = spans.pop()
        start, end = min(s, start), max(e, end)
    spans.append((start, end))


def automata(benchmark: DataFrame, p: Params = Params()) -> list[Automaton]:
    """Automata over all items, each of at most ``automaton_words`` words (one item at least).

    Items with null or wordless text have no windows.  Rows with one item_id are one item.
    """
    out: list[Automaton] = []
    held: list[tuple[str, list[bytes]]] = []
    total = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), utf8(F.col("text")).alias("t")).toLocalIterator():
        ws = words(bytes(r.t))
        if held and total + len(ws) > p.automaton_words:
            out.append(Automaton.of(held, p.min_length, p.pair_bits))
            held, total = [], 0
        held.append((r.i or "", ws))
        total += len(ws)
    return [*out, Automaton.of(held, p.min_length, p.pair_bits)]


def find(docs: DataFrame, benchmark: DataFrame, p: Params, keep: tuple[Column, ...], then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], result: str) -> DataFrame:
    """``then`` of (*keep, _text, _spans, _items): flattened word spans and item ids found in each row of ``docs``.

    ``result`` is the DDL of what ``then`` gives; it runs in the workers of the last pass, so
    that no text goes through a second one.

    A benchmark too large for one automaton is met by one pass over the stream per
    automaton, each adding to the spans and items of the one before; only one is ever
    applied by a stage, and the documents are read once.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(
        *keep, utf8(F.col("text")).alias("_text"), F.array().cast("array<long>").alias("_spans"), F.array().cast("array<string>").alias("_items")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    *before, last = automata(benchmark, p)
    for a in (*before, last):
        held = sc.broadcast(a)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans, items = b.column("_spans").to_pylist(), b.column("_items").to_pylist()
                for first, part in chunks(texts(b.column("_text"))):
                    for i, (s, own) in enumerate(held.value.scan([words(t) for t in part]), first):
                        if s:
                            merged: list[tuple[int, int]] = []
                            for x in sorted([*s, *zip(spans[i][::2], spans[i][1::2])]):
                                _cover(merged, *x)
                            spans[i] = [y for x in merged for y in x]
                            items[i] = sorted({*items[i], *own})
                cols = [b.column(i) for i in range(b.num_columns - 2)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=b.schema.names
                )

        if a is last:
            return out.mapInArrow(tidy(lambda batches, scan=scan: then(scan(batches))), result)
        out = out.mapInArrow(tidy(scan), fields)


def strip(text: bytes, spans: list[int]) -> bytes:
    """``text`` without its words of ``spans`` and all that stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for s, e in zip(spans[::2], spans[1::2]):
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with matching spans cut out of ``text``, and ``n_chars`` renewed where there is such a column.

    Rows of which more than ``max_coverage`` of the words lie in spans are dropped.  Rows
    without a span stay as they are: null and empty texts too.  Extra columns are carried,
    whatever their names; repeated rows are treated alike.  An empty benchmark changes
    nothing.
    """
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, cleaned = [], []
            for t, s in zip(texts(b.column("_text")), b.column("_spans").to_pylist()):
                hit = sum(s[1::2]) - sum(s[::2])
                keep.append(not s or hit <= p.max_coverage * len(words(t)))
                cleaned.append(strip(t, s).decode("utf-8", "replace") if s and keep[-1] else None)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(cleaned, pa.string())], names=["_row", "_cut"]).filter(mask)

    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    cut = find(docs, benchmark, p, (row,), clean, f"_row {docs.select(row).schema['_row'].dataType.simpleString()}, _cut string")
    renewed = {"text": F.coalesce(F.col("_cut"), F.col("_row.text"))}
    if "n_chars" in names:
        renewed["n_chars"] = F.when(F.col("_cut").isNull(), F.col("_row.n_chars")).otherwise(F.length("_cut")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[renewed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])


def report(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are never contaminated.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = [len(words(t)) for t in texts(b.column("_text"))]
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in b.column("_spans").to_pylist()]
            items = b.column("_items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([len(x) >= 2 for x in items]),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return find(docs, benchmark, p, (F.col("doc_id"),), count, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win
    FROM b, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS u(i) WHERE len(w) > 0),
dw AS (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
hit AS (SELECT DISTINCT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw USING (k, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, k, i FROM hit), unnest(range(i, i + k)) AS u(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(it.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
