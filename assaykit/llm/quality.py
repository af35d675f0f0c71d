"""Quality rules: counts of degenerate text, and divergence from language references.

A language's reference is two histograms over all its documents: of character classes and
of common words (those with at least ``2 * common_share`` of the language's words).  A
document is compared to each language by Jensen-Shannon distance (base 2, 0 to 1) and
judged by its nearest one.  Short documents, whose histograms are noise, pass unjudged.

Common words are found exactly with bounded state: in a block of words only words of
``common_share`` of the block count; a word of twice that share overall gathers
at least ``common_share`` of all words in such blocks, and at most 1 / ``common_share``
words can, so those alone are counted in full in a second pass.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import arrow, chunks, ddl, offsets_of, split_column, table, texts, tidy, utf8

WINDOW = 8
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "punctuation", "symbol", "beyond_ascii", "control")
_SKIP = len(CLASSES)


def _class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("control"), np.int64)
    for name, own in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", b" \t"), ("line", b"\n\r\x0b\x0c"), ("stop", b".,"), ("punctuation", b";:!?'\"()-/"), ("symbol", b"#*$%&|<>@[\\]^_`{}~+=")):
        out[list(own)] = CLASSES.index(name)
    out[0x80:0xC0] = _SKIP  # continuation bytes
    out[0xC0:] = CLASSES.index("beyond_ascii")
    return out


_CLASS = _class_table()
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_IS_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_IS_TAIL = (np.arange(256) & 0xC0) == 0x80


@dataclass(frozen=True)
class Params:
    least_words: int = 20
    #: Percentage of words in repeated windows above which a document fails.
    most_repeated: int = 30
    #: Half the least share of a common word; its inverse bounds the words of a reference.
    common_share: float = 0.002
    block_words: int = 200_000
    #: Guards: shorter documents are not judged by the histogram in question.
    guard_chars: int = 200
    guard_words: int = 50
    max_char_distance: float = 0.32
    max_word_distance: float = 0.43
    #: Languages with a reference: those of most documents, of equals the first by name.
    max_languages: int = 500


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    return _base_counts(texts, *split_column(pa.array(texts, pa.large_binary())))


def _base_counts(texts: list[bytes], words: pa.Array, index: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    n = np.diff(at)
    raw = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    starts = offsets_of(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[:-1]
    sums = [np.add.reduceat(x[raw], starts, dtype=np.int64) for x in (~(_IS_SPACE | _IS_TAIL), _IS_SYMBOL)]
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > len(set(lines)):
            lines = [x for x in lines if x.strip()]
            dup[i] = len(lines) - len(set(lines))
    repeated = np.zeros(len(texts), np.int64)
    if len(index) >= WINDOW:
        owner = np.repeat(np.arange(len(texts)), n)
        width = len(index) - WINDOW + 1
        key = owner[:width].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(WINDOW):
            key = (key + index[j : j + width].view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        whole = np.flatnonzero(owner[:width] == owner[WINDOW - 1 :])
        order = whole[np.argsort(key[whole], kind="stable")]
        a, b = order[:-1], order[1:]
        same = key[a] == key[b]
        a, b = a[same], b[same]
        if (owner[a] != owner[b]).any() or any((index[a + j] != index[b + j]).any() for j in range(WINDOW)):  # unequal windows of one key
            number = np.unique(np.column_stack([owner[whole], *(index[whole + j] for j in range(WINDOW))]), axis=0, return_inverse=True)[1].ravel()
            order = whole[np.argsort(number, kind="stable")]
            same = np.diff(np.sort(number)) == 0
            a, b = order[:-1][same], order[1:][same]
        twice = np.zeros(len(index) + 1, np.int64)
        hit = np.unique(np.concatenate([a, b]))
        twice[hit] += 1
        np.subtract.at(twice, hit + WINDOW, 1)
        covered = offsets_of(np.cumsum(twice)[:-1] > 0)
        repeated = covered[at[1:]] - covered[at[:-1]]
    return {"n_words": n, "word_chars": sums[0], "n_symbols": sums[1], "n_dup_lines": dup, "n_repeat_words": repeated}


def char_histograms(texts: list[bytes]) -> np.ndarray:
    """[text, class] counts of characters."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    k = len(CLASSES) + 1
    return np.bincount(owner * k + _CLASS[raw], minlength=k * len(texts)).reshape(-1, k)[:, :-1]


_WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
_HISTOGRAM = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("place", pa.int32()), ("n", pa.int64())])


@dataclass(frozen=True)
class References:
    languages: tuple[str, ...]
    #: word -> column of the word histogram; the last column is of all other words.
    column: dict[bytes, int]
    chars: np.ndarray
    words: np.ndarray


def _with_language(docs: DataFrame, p: Params) -> DataFrame:
    had = docs.where(F.col("lang").isNotNull())
    names = [r.lang for r in had.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.max_languages).collect()]
    return had.where(F.col("lang").isin(names)).select("lang", utf8(F.col("text")).alias("_text"))


def _common_words(had: DataFrame, p: Params) -> dict[str, set[bytes]]:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        size: Counter = Counter()

        def closed(lang: str) -> pa.RecordBatch:
            n = size.pop(lang)
            often = [(w, k) for w, k in seen.pop(lang).items() if k >= p.common_share * n]
            return arrow(_WORDS, lang=[lang] * (len(often) + 1), word=[*(w for w, _ in often), b""], n=[*(k for _, k in often), n])

        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), texts(b.column("_text"))):
                ws = t.lower().split()
                if ws:
                    seen[lang].update(ws)
                    size[lang] += len(ws)
                    if size[lang] >= p.block_words:
                        yield closed(lang)
        for lang in list(size):
            yield closed(lang)

    sums = had.mapInArrow(tidy(fold), ddl(_WORDS)).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    total = sums.where(F.length("word") == 0).select("lang", F.col("n").alias("total"))
    often = sums.where(F.length("word") > 0).join(total, "lang").where(F.col("n") >= p.common_share * F.col("total"))
    out: dict[str, set[bytes]] = defaultdict(set)
    for r in often.select("lang", "word").toLocalIterator():
        out[r.lang].add(bytes(r.word))
    return out


def references(docs: DataFrame, p: Params = Params()) -> References:
    """Histograms of every language over all rows with a language and a word (see ``max_languages``)."""
    had = _with_language(docs, p)
    maybe = _common_words(had, p)
    column = {w: i for i, w in enumerate(sorted(set().union(*maybe.values())))} if maybe else {}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        words: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for first, part in chunks(texts(b.column("_text"))):
                for lang, t, c in zip(langs[first:], part, char_histograms(part)):
                    if lang not in chars:
                        chars[lang], words[lang] = np.zeros(len(CLASSES), np.int64), np.zeros(len(column) + 1, np.int64)
                    chars[lang] += c
                    words[lang] += _word_histogram(t.lower().split(), column)
        for lang in chars:
            for kind, x in enumerate((chars[lang], words[lang])):
                at = np.flatnonzero(x)
                yield arrow(_HISTOGRAM, lang=[lang] * len(at), kind=np.full(len(at), kind, np.int32), place=at.astype(np.int32), n=x[at])

    got = had.mapInArrow(tidy(fold), ddl(_HISTOGRAM)).groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).collect()
    names = tuple(sorted(maybe))
    chars, words = np.zeros((len(names), len(CLASSES))), np.zeros((len(names), len(column) + 1))
    for r in got:
        if r.lang in maybe:
            (words if r.kind else chars)[names.index(r.lang), r.place] = r.n
    share = words / np.maximum(words.sum(1, keepdims=True), 1)
    common = np.flatnonzero((share[:, :-1] >= 2 * p.common_share).any(0))
    by_place = sorted(column, key=column.__getitem__)
    other = words.sum(1) - words[:, common].sum(1)
    return References(names, {by_place[i]: k for k, i in enumerate(common)}, _shares(chars), _shares(np.column_stack([words[:, common], other])))


def _word_histogram(ws: list[bytes], column: dict[bytes, int]) -> np.ndarray:
    get, other = column.get, len(column)
    return np.bincount(np.fromiter((get(w, other) for w in ws), np.int64, len(ws)), minlength=other + 1)


def _shares(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance between distributions along the last axis."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return (x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1))).sum(-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def nearest(p: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distance of each distribution to the nearest reference, one reference at a time."""
    out = np.full(len(p), np.inf)
    for q in references:
        np.minimum(out, distance(p, q), out=out)
    return out


#: Counts of word histograms held at once.
_CELLS = 1 << 21


def measure(texts: list[bytes], r: References, p: Params) -> dict[str, np.ndarray]:
    """Base counts, distances to the nearest reference of each kind, and the verdicts."""
    words, index, offsets = split_column(pa.array(texts, pa.large_binary()))
    out = _base_counts(texts, words, index, offsets)
    n = out["n_words"]
    histograms = char_histograms(texts)
    n_chars = histograms.sum(1)
    char_d, word_d = np.zeros(len(texts)), np.zeros(len(texts))
    if r.languages:
        char_d = nearest(_shares(histograms), r.chars)
        get, other = r.column.get, len(r.column)
        column = np.array([get(w.lower(), other) for w in words.to_numpy(zero_copy_only=False).tolist()], np.int64)[index] if len(words) else index
        some = max(1, _CELLS // (other + 1))
        for s in range(0, len(texts), some):
            e = min(s + some, len(texts))
            own = np.repeat(np.arange(e - s), n[s:e]) * (other + 1) + column[offsets[s] : offsets[e]]
            word_d[s:e] = nearest(_shares(np.bincount(own, minlength=(e - s) * (other + 1)).reshape(e - s, -1)), r.words)
    failed = (n < p.least_words) | (100 * out["n_repeat_words"] > p.most_repeated * n)
    far = (n_chars >= p.guard_chars) & (char_d > p.max_char_distance) | (n >= p.guard_words) & (word_d > p.max_word_distance)
    return out | {"char_distance": char_d, "word_distance": word_d, "base_failed": failed, "kept": ~failed & ~far}


_MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "char_distance": "double", "word_distance": "double", "base_failed": "boolean", "kept": "boolean"}


def judge(docs: DataFrame, r: References, p: Params = Params(), keep: tuple[Column, ...] | None = None) -> DataFrame:
    """(*keep, measures) of each row of ``docs``; ``keep`` is doc_id alone if not given.

    Null and empty texts have no words and so fail.  With no references (no row with a
    language) only the base rules judge.  Repeated rows are each judged.
    """
    held = docs.sparkSession.sparkContext.broadcast(r)
    source = docs.select(*(keep or (F.col("doc_id"),)), utf8(F.col("text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [measure(part, held.value, p) for _, part in chunks(texts(b.column("_text")))]
            cols = [pa.array(np.concatenate([x[k] for x in parts]) if parts else []) for k in _MEASURES]
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            cols = [c.cast(kinds[k]) for c, k in zip(cols, _MEASURES.values())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *_MEASURES])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(tidy(run), ", ".join([fields, *(f"{k} {v}" for k, v in _MEASURES.items())]))


def keep_good(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, judged by references from ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return judge(docs, references(docs, p), p, (row,)).where("kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
