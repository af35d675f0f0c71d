"""Taggers: by gazetteer, and a trained one with token scores and Viterbi decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.lookup import lookup_join

_FEATURES = 1 << 16
#: Tokens that are scored at once.
_BLOCK = 1 << 16


def gazetteer_tags(tokens: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``tokens`` with tag: words of (tok, type) are B-type, or I-type right after a word of that type; others O."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    forms = gazetteer.groupBy("tok").agg(F.min("type").alias("_type"))
    # a shuffle by word would gather all tokens of a frequent one in a task
    found = lookup_join(tokens, forms, "tok")
    inside = F.col("_type").eqNullSafe(F.lag("_type").over(w))
    return found.withColumn("tag", F.when(F.col("_type").isNull(), "O").otherwise(F.concat(F.when(inside, "I-").otherwise("B-"), "_type"))).drop("_type")


def viterbi(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[list[int], float]:
    """The best path and its score: [position, tag] scores, [tag, next tag] moves."""
    if not len(scores):
        return [], 0.0
    best, back = start + scores[0], []
    for s in scores[1:]:
        total = best[:, None] + moves
        back.append(total.argmax(0))
        best = total.max(0) + s
    best = best + stop
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(best.max())


def features(words: list[str]) -> list[list[int]]:
    """Hashed features of each word: itself, its ends, shape and neighbours."""
    import zlib

    def h(*x: str) -> int:
        return zlib.crc32("\x01".join(x).encode()) % _FEATURES

    out = []
    low = [w.lower() for w in words]
    for i, w in enumerate(words):
        shape = "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in w)[:8]
        before, after = low[i - 1] if i else "<s>", low[i + 1] if i + 1 < len(low) else "</s>"
        out.append([h("w", low[i]), h("p", low[i][:3]), h("s", low[i][-3:]), h("f", shape), h("-1", before), h("+1", after), h("b")])
    return out


def _own_features(words: list[str]) -> np.ndarray:
    """[word, 6]: of each word by itself, the hashes of itself, its ends and shape, and those it gives the words after and before it."""
    import zlib

    def h(*x: str) -> int:
        return zlib.crc32("\x01".join(x).encode()) % _FEATURES

    out = np.empty((len(words), 6), np.int32)
    for i, w in enumerate(words):
        shape = "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in w)[:8]
        low = w.lower()
        out[i] = h("w", low), h("p", low[:3]), h("s", low[-3:]), h("f", shape), h("-1", low), h("+1", low)
    return out


def feature_table(words: pa.StringArray, lengths: np.ndarray) -> np.ndarray:
    """[word, 7]: ``features`` of sentences one after the other, each distinct word hashed once."""
    import zlib

    edge = [zlib.crc32(x.encode()) % _FEATURES for x in ("-1\x01<s>", "+1\x01</s>", "b")]
    own = words.dictionary_encode()
    f = _own_features(own.dictionary.to_pylist())[own.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty((0, 6), np.int32)
    out = np.empty((len(f), 7), np.int32)
    out[:, :4], out[:, 6] = f[:, :4], edge[2]
    out[1:, 4], out[:-1, 5] = f[:-1, 4], f[1:, 5]
    lengths = lengths[lengths > 0]
    stops = np.cumsum(lengths)
    out[stops - lengths, 4], out[stops - 1, 5] = edge[0], edge[1]
    return out


def viterbi_all(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The best paths of sentences one after the other, none of them empty: ``viterbi`` of each, a place of all at a time."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    size, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
    best = np.empty((n, len(start)))
    best[:] = start + scores[first]
    back, live = [], n
    for t in range(1, int(size[0]) if n else 0):
        live = int(np.searchsorted(-size, -t, side="left"))  # sentences longer than t
        total = best[:live, :, None] + moves
        back.append(total.argmax(1))
        best[:live] = total.max(1) + scores[first[:live] + t]
    out = np.empty(len(scores), np.int64)
    tag = (best + stop).argmax(1)
    if n:
        out[first + size - 1] = tag
    for t in range(len(back) - 1, -1, -1):
        live = len(back[t])
        tag[:live] = back[t][np.arange(live), tag[:live]]
        out[first[:live] + t] = tag[:live]
    return out


def _scores(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    total = weights[f[:, 0]]
    for k in range(1, f.shape[1]):  # in the order of a sum over them
        total = total + weights[f[:, k]]
    return total


@dataclass(frozen=True)
class TagModel:
    """Structured averaged perceptron: the trainable stand-in for a pretrained network."""

    tags: tuple[str, ...]
    weights: np.ndarray  # [feature, tag]
    moves: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    def tag(self, words: list[str]) -> list[str]:
        if not words:
            return []
        scores = np.array([self.weights[f].sum(0) for f in features(words)])
        return [self.tags[i] for i in viterbi(scores, self.moves, self.start, self.stop)[0]]

    def tag_all(self, words: pa.ListArray) -> pa.ListArray:
        """The tags of the sentences of a batch; null ones have none."""
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        paths = np.empty(0, np.int64)
        if n.sum():
            f = feature_table(pc.fill_null(words.flatten(), ""), n)
            # a block of sentences at a time: scores of a whole batch may not fit
            own, parts = n[n > 0], []
            stops = np.cumsum(own)
            k = 0
            while k < len(own):
                begin = stops[k] - own[k]
                to = max(k + 1, int(np.searchsorted(stops, begin + _BLOCK, side="right")))
                parts.append(viterbi_all(_scores(self.weights, f[begin : stops[to - 1]]), own[k:to], self.moves, self.start, self.stop))
                k = to
            paths = np.concatenate(parts)
        names = pa.array(self.tags, pa.string()).take(pa.array(paths)) if len(paths) else pa.array([], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), names)

    def save(self, folder: str) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        np.savez_compressed(Path(folder, "weights.npz"), weights=self.weights, moves=self.moves, start=self.start, stop=self.stop)
        Path(folder, "tags.json").write_text(json.dumps(self.tags))

    @classmethod
    def load(cls, folder: str) -> TagModel:
        with np.load(Path(folder, "weights.npz"), allow_pickle=False) as z:
            return cls(tuple(json.loads(Path(folder, "tags.json").read_text())), z["weights"], z["moves"], z["start"], z["stop"])


class _Shard:
    """Weights of one shard in an epoch; it learns from sentences in order, as if one by one.

    A run of sentences is decoded at once with the weights at hand; those before the first that is
    wrong leave the weights as they are, so only what follows it is decoded again.
    """

    def __init__(self, model: TagModel, rate: float):
        self.w, self.m, self.s, self.e = model.weights.copy(), model.moves.copy(), model.start.copy(), model.stop.copy()
        self.rate, self.run, self.touched = rate, 8, np.zeros(len(model.weights), bool)

    def learn(self, f: np.ndarray, want: np.ndarray, lengths: np.ndarray) -> None:
        stops, k = np.cumsum(lengths), 0
        while k < len(lengths):
            begin = stops[k] - lengths[k]
            to = min(k + self.run, max(k + 1, int(np.searchsorted(stops, begin + _BLOCK, side="right"))))
            here, own = slice(begin, stops[to - 1]), lengths[k:to]
            got = viterbi_all(_scores(self.w, f[here]), own, self.m, self.s, self.e)
            wrong = np.flatnonzero(got != want[here])
            if not len(wrong):
                k, self.run = to, min(2 * self.run, 4096)
                continue
            bad = k + int(np.searchsorted(stops[k:to] - begin, wrong[0], side="right"))
            a, b = stops[bad] - lengths[bad], stops[bad]
            self._update(f[a:b], want[a:b], got[a - begin : b - begin])
            self.run, k = max(1, min(4096, (self.run + 2 * (bad + 1 - k)) // 2)), bad + 1

    def _update(self, f: np.ndarray, want: np.ndarray, got: np.ndarray) -> None:
        at = np.flatnonzero(want != got)
        for i in at.tolist():
            # a word whose features share a number changes it once, as an assignment by index does
            self.w[f[i], want[i]] += self.rate
            self.w[f[i], got[i]] -= self.rate
        self.touched[f[at].ravel()] = True
        for path, sign in ((want, self.rate), (got, -self.rate)):
            self.s[path[0]] += sign
            self.e[path[-1]] += sign
            np.add.at(self.m, (path[:-1], path[1:]), sign)

    def delta(self, model: TagModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.touched)
        change = self.w[at] - model.weights[at]
        any_ = change.any(1)
        return at[any_], change[any_], np.concatenate([x.ravel() for x in (self.m, self.s, self.e)])


def _prepared(rows: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(shard, features, want, lengths) of (_shard, words, tags): each shard's sentences in order, as packed numbers in blocks, shards one after the other."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        order = sorted(range(t.num_rows), key=lambda i, w=t["words"].to_pylist(), g=t["tags"].to_pylist(): (w[i], g[i]))
        t = t.take(pa.array(order)).combine_chunks()
        words, gold = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (t["words"], t["tags"]))
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, want = words.flatten(), pc.index_in(gold.flatten(), pa.array(tags, pa.string())).to_numpy(zero_copy_only=False).astype(np.uint16)
        stops, k, out = np.cumsum(n), 0, []
        while k < len(n):
            begin = stops[k] - n[k]
            to = max(k + 1, int(np.searchsorted(stops, begin + 16 * _BLOCK, side="right")))
            f = feature_table(flat[begin : stops[to - 1]], n[k:to])
            out.append((key[0].as_py(), len(out), f.astype(np.uint16).tobytes(), want[begin : stops[to - 1]].tobytes(), n[k:to].tobytes()))
            k = to
        return pa.table(list(map(list, zip(*out))), names=["shard", "block", "features", "want", "lengths"])

    packed = rows.groupBy("_shard").applyInArrow(pack, "shard long, block long, features binary, want binary, lengths binary")
    return packed.persist(StorageLevel.DISK_ONLY)


def train_tagger(sentences: DataFrame, dev: DataFrame | None = None, epochs: int = 8, decay: float = 0.9, patience: int = 4, shards: int | None = None) -> TagModel:
    """Learns from (words array, tags array): iterative parameter mixing over ``shards`` (one for 20,000 sentences, 8 at least, if not given), rate decay, early stop on ``dev``.

    Every epoch trains each shard from the common weights and averages; with ``dev`` the
    epoch of the best token accuracy is returned, and training ends after ``patience``
    epochs without a better one.  Words are hashed once, before the epochs.
    """
    spark = sentences.sparkSession
    rows = sentences.where(F.size("words") > 0).select("words", "tags").persist(StorageLevel.DISK_ONLY)
    shards = shards or max(8, -(-rows.count() // 20_000))
    tags = tuple(r[0] for r in rows.select(F.explode("tags").alias("t")).distinct().orderBy("t").collect())
    n = len(tags)
    model = TagModel(tags, np.zeros((_FEATURES, n), np.float32), np.zeros((n, n)), np.zeros(n), np.zeros(n))
    # rows are dealt by number, so that copies of a sentence are spread
    packed = _prepared(rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("_shard"), "words", "tags"), tags)
    best, best_score, bad, rate = model, -1.0, 0, 1.0
    for epoch in range(epochs):
        held, now = spark.sparkContext.broadcast(model), rate

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.schema([("at", pa.int64()), ("v", pa.list_(pa.float64()))])

            def changed(shard: _Shard) -> pa.RecordBatch:
                at, delta, rest = shard.delta(held.value)
                return pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*delta.astype(float).tolist(), rest.tolist()], pa.list_(pa.float64()))], schema=kind)

            number, shard = None, None
            for b in batches:
                for key, f, want, lengths in zip(*(b.column(c).to_pylist() for c in ("shard", "features", "want", "lengths"))):
                    if key != number:
                        if shard is not None:
                            yield changed(shard)
                        number, shard = key, _Shard(held.value, now)
                    shard.learn(np.frombuffer(f, np.uint16).reshape(-1, 7).astype(np.int32), np.frombuffer(want, np.uint16).astype(np.int64), np.frombuffer(lengths, np.int64))
            if shard is not None:
                yield changed(shard)

        got = packed.mapInArrow(fit, "at long, v array<double>")
        mixed = got.select("at", F.posexplode("v").alias("i", "x")).groupBy("at", "i").agg(F.sum("x").alias("x"), F.count("*").alias("k")).toArrow()
        at, i, x, k = (mixed[c].to_numpy() for c in ("at", "i", "x", "k"))
        most = int(k[at < 0].max()) if (at < 0).any() else 1
        w, rest = model.weights.copy(), np.zeros(n * n + 2 * n)
        rest[i[at < 0]] = x[at < 0] / most
        w[at[at >= 0], i[at >= 0]] += x[at >= 0] / most
        model = TagModel(tags, w, rest[: n * n].reshape(n, n), rest[n * n : n * n + n], rest[n * n + n :])
        if not epoch:
            rows.unpersist()  # all blocks of the packed ones are there
        if dev is None:
            best = model
        else:
            own = tag_arrays(dev, model).select(F.explode(F.zip_with("tags", "predicted", lambda a, b: (a == b).cast("int"))).alias("x"))
            score = own.agg(F.avg("x")).first()[0] or 0.0
            best, best_score, bad = (model, score, 0) if score > best_score else (best, best_score, bad + 1)
            if bad >= patience:
                break
        rate *= decay
    packed.unpersist()
    return best


def tag_arrays(sentences: DataFrame, model: TagModel) -> DataFrame:
    """``sentences`` with predicted, the tags of its words; words arrive and leave as Arrow batches."""
    held = sentences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, held.value.tag_all(b.column("words"))], names=[*b.schema.names, "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema)
    return sentences.mapInArrow(run, f"{fields}, predicted array<string>")


def tag_tokens(tokens: DataFrame, model: TagModel, shown: str = "tok") -> DataFrame:
    """(doc_id, sent_id, pos, tok, tag): a token table tagged sentence by sentence; ``shown`` is the column to show (raw numbers)."""
    sent = tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", F.col(shown).alias("shown")))).alias("_t"))
    sent = sent.select("doc_id", "sent_id", F.transform("_t", lambda x: x["tok"]).alias("words"), F.transform("_t", lambda x: x["shown"]).alias("shown"))
    pairs = tag_arrays(sent, model).select("doc_id", "sent_id", F.posexplode(F.zip_with("shown", "predicted", lambda t, g: F.struct(t.alias("tok"), g.alias("tag")))).alias("pos", "_p"))
    return pairs.select("doc_id", "sent_id", "pos", "_p.tok", "_p.tag")
