"""Helpers shared by the corpus operators.

Text enters Python as Arrow binary (UTF-8), never as one Python string per Spark row
conversion: ASCII case folding and white-space splitting are then single C calls
(``bytes.lower``, ``bytes.split``).
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.deploy import shared_folder, ship

#: Bytes of text that one vectorised step works on; longer documents form a step alone.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker, where the session names none of its own: an
#: executor holds several at once, in the JVM and in its workers, beside what it has for good.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id written as text, modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(k)).cast("int")


def utf8(text: Column) -> Column:
    """The text's bytes; a null text counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the cluster's shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread_join(rows: DataFrame, values: DataFrame, key: str, times: str, total: int, hot: int = 50_000) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per key), whatever share of rows a key has.

    ``times`` is the column of ``values`` with the number of rows of the key.  Keys of more than
    1 / ``hot`` of all ``total`` rows, at most ``hot`` of them, are broadcast; the others shuffle.
    """
    often = F.col(times) > max(1, -(-total // hot))
    frequent, rest = values.where(often).drop(times), values.where(~often).drop(times)
    return rows.join(F.broadcast(frequent), key).unionByName(rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(rest, key))


def chunks(texts: Iterable, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """(index of the first, texts) of consecutive runs of at most ``size`` bytes, one text at least."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        if held and total + len(t) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(t)
        total += len(t)
    if held:
        yield first, held


def arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def ddl(schema: pa.Schema) -> str:
    """The Spark DDL of a flat Arrow schema."""
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}

    def kind(t: pa.DataType) -> str:
        return f"array<{kind(t.value_type)}>" if pa.types.is_list(t) else names[t]

    return ", ".join(f"`{f.name}` {kind(f.type)}" for f in schema)


def texts(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """A column's values, a few rows at a time: a batch's texts are never all held twice."""
    for s in range(0, len(column), rows):
        yield from column.slice(s, rows).to_pylist()


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of each word among them, offsets of the texts' words).

    Words are runs without ASCII white space; A-Z are lower-cased.  Splitting and numbering
    are single calls over all texts; only distinct words become Python objects.
    """
    words, index, offsets = split_column(pa.array([t.lower() for t in texts], pa.large_binary()))
    return words.to_numpy(zero_copy_only=False).tolist(), index, offsets


def split_column(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``split_words`` of a large binary column as it is, the distinct words as an Arrow array."""
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(column), column.buffers()))
    coded = split.values.dictionary_encode()
    index, offsets = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    none = pc.index(coded.dictionary, "").as_py()  # beside white space at a text's ends
    if none >= 0:
        real = index != none
        offsets = offsets_of(real)[offsets]
        index = index[real]
    return coded.dictionary.cast(pa.large_binary()), index, offsets


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep_heap(size: int = 64 << 20) -> None:
    """Lets this process keep ``size`` bytes of freed heap for what it makes next, until it is trimmed.

    Loops that make arrays of a megabyte at every step otherwise get their pages from the system
    each time, which takes as long as much of the work on them.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, the most there is
        libc.mallopt(-1, size)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokenizes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for ``mapInArrow``, with memory handed back after every batch: workers live on between stages.

    What tokenizers remember goes too, unless ``f`` uses it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokenizes and (tokens := sys.modules.get("assaykit.llm.tokens")):
            tokens.word_bpe.cache_clear()
            _trim()

        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                _trim()

        yield from f(each())
        _trim()

    return run


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs starts, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
