"""Readers: CoNLL, vocabularies, vectors, dictionaries and document stores.

Small line-numbered formats are read as whole texts, so that line numbers are those of
their file however Spark splits it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.lexicon import DICTIONARY_TYPES


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line) with line numbers from 0; carriage returns go."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))


def parse_conll(files: DataFrame, max_sentences: int | None = None, compat: bool = False) -> DataFrame:
    """(file, sent_id, pos, tok, tag) of (file, at, line): word first, tag last on a line; blank and -DOCSTART- lines end sentences.

    ``compat`` drops a last sentence that no blank line ends.
    """
    from pyspark.sql import Window

    # all windows have one partitioning and order, so lines are shuffled and sorted once
    w = Window.partitionBy("file").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    end = (F.trim("line") == "") | F.col("line").startswith("-DOCSTART-")
    rows = files.withColumn("_end", end).withColumn("_ended", F.sum(end.cast("int")).over(upto))
    if compat:
        last = F.max(F.when(F.col("_end"), F.col("_ended"))).over(Window.partitionBy("file"))
        rows = rows.withColumn("_last_run", last).where(F.col("_ended") < F.coalesce("_last_run", F.lit(0)))
    rows = rows.where(~F.col("_end") & (F.col("line") != ""))
    rows = rows.withColumns({"_new": ~F.col("_ended").eqNullSafe(F.lag("_ended").over(w)), "_n": F.row_number().over(w)})
    sent = F.sum(F.col("_new").cast("int")).over(upto).cast("int") - 1
    pos = F.col("_n") - F.max(F.when(F.col("_new"), F.col("_n"))).over(upto)
    fields = F.split(F.trim("line"), " +")
    out = rows.select("file", sent.alias("sent_id"), pos.alias("pos"), fields[0].alias("tok"), F.element_at(fields, -1).alias("tag"))
    return out if max_sentences is None else out.where(F.col("sent_id") < max_sentences)


def _parsed(batches: Iterator[pa.RecordBatch], compat: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pc.fill_null(pc.list_value_length(b.column("lines")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        lines, row = b.column("lines").flatten(), np.repeat(np.arange(len(n)), n)
        shown = pc.utf8_trim(lines, " ")
        end = pc.fill_null(pc.or_(pc.equal(shown, ""), pc.starts_with(lines, "-DOCSTART-")), True).to_numpy(zero_copy_only=False)
        keep = ~end
        if compat:
            last = np.full(len(n), -1)
            np.maximum.at(last, row[end], np.flatnonzero(end))
            keep &= np.arange(len(row)) < last[row]
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        row, run = row[at], np.cumsum(end)[at]
        opens = np.append(True, row[1:] != row[:-1])
        new = opens | np.append(True, run[1:] != run[:-1])
        sent = np.cumsum(new) - 1
        begin = np.flatnonzero(new)[sent]
        fields = pc.split_pattern(shown.take(pa.array(at)), " ")
        bounds = fields.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [b.column("file").take(pa.array(row)), pa.array(sent - sent[opens][np.cumsum(opens) - 1], pa.int32()), pa.array(np.arange(len(at)) - begin, pa.int32()), fields.values.take(pa.array(bounds[:-1])), fields.values.take(pa.array(bounds[1:] - 1))],
            names=["file", "sent_id", "pos", "tok", "tag"],
        )


def parse_conll_files(files: DataFrame, compat: bool = False) -> DataFrame:
    """``parse_conll`` of (file, lines array), a row for every file: nothing is shuffled or sorted."""
    return files.select("file", "lines").mapInArrow(lambda batches: _parsed(batches, compat), "file string, sent_id int, pos int, tok string, tag string")


def read_conll(spark: SparkSession, path: str, max_sentences: int | None = None, compat: bool = False, word: Column | None = None, tag: Column | None = None) -> DataFrame:
    """A CoNLL file's tokens; ``word`` and ``tag`` are expressions over tok and tag that take their places."""
    out = parse_conll(_lines(spark, path), max_sentences, compat)
    return out.withColumns({k: v for k, v in (("tok", word), ("tag", tag)) if v is not None})


def count_sentences(conll: DataFrame) -> int:
    return conll.select("file", "sent_id").distinct().count()


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(tok, idx): line numbers; of a word on several lines the last."""
    return _lines(spark, path).where("line <> ''").groupBy(F.trim("line").alias("tok")).agg(F.max("at").alias("idx"))


def read_embedding_words(spark: SparkSession, path: str) -> DataFrame:
    """(tok): distinct first fields of a text of vectors."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("tok")).where("tok <> ''").distinct()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) from Parquet; only the columns asked for are scanned."""
    return spark.read.parquet(path)


def read_npz(spark: SparkSession, path: str, array: str = "embeddings") -> DataFrame:
    """(file, idx, vec): rows of a matrix in .npz files, each decoded by a task; pickled content is refused."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    m = z[array].astype(float)
                for s in range(0, len(m), 4096):
                    part = m[s : s + 4096]
                    yield pd.DataFrame({"file": name, "idx": np.arange(s, s + len(part)), "vec": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, idx long, vec array<double>")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of JSON files that each hold one object of texts."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_entity_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(type, entity, most_common) of <type>.json dictionaries, entities in upper case."""
    out = None
    for t in DICTIONARY_TYPES:
        one = read_map(spark, f"{folder}/{t.lower()}.json").select(F.lit(t).alias("type"), F.upper("key").alias("entity"), F.col("value").alias("most_common"))
        out = one if out is None else out.unionByName(one)
    return out


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(formula, surface, cnt) of a JSON object of formulas, each an object of forms and counts."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("formula", "_forms"))
    return whole.select("formula", F.explode("_forms").alias("surface", "cnt"))


def names_dictionary(lines: DataFrame) -> DataFrame:
    """(name, formula) of (priority, line) "name – formula": first letter in lower case, the highest priority's formula."""
    parts = F.split("line", " – ")
    name = F.concat(F.lower(F.substring(F.trim(parts[0]), 1, 1)), F.substring(F.trim(parts[0]), 2, 1 << 20))
    rows = lines.where(F.size(parts) == 2).select("priority", name.alias("name"), F.trim(parts[1]).alias("formula"))
    return rows.groupBy("name").agg(F.max_by("formula", F.struct("priority", "formula")).alias("formula"))


def names_by_formula(names: DataFrame) -> DataFrame:
    return names.groupBy("formula").agg(F.array_sort(F.collect_set("name")).alias("names"))


def with_bare_names(names: DataFrame) -> DataFrame:
    """``names`` and aliases without a valency such as " (IV)"; a real name holds over an alias."""
    bare = names.select(F.regexp_replace("name", r"\s*[(][IV,]+[)]", "").alias("name"), "formula", F.lit(0).alias("_p"))
    both = names.withColumn("_p", F.lit(1)).unionByName(bare)
    return both.groupBy("name").agg(F.max_by("formula", F.struct("_p", "formula")).alias("formula"))


def select_abstracts(store: DataFrame, ids: list | None = None, year_max: int | None = None, limit: int | None = None, sample: int | None = None, key: str = "doi") -> DataFrame:
    """Rows of a document store by id, latest year, number, or a repeatable random sample; filters are pushed into the scan."""
    from assaykit.operators.tokens import sample as take

    out = store
    if ids is not None:
        out = out.where(F.col(key).isin(*ids))
    if year_max is not None:
        out = out.where(F.col("year") < year_max + 1)
    if sample is not None:
        return take(out, key, sample)
    return out if limit is None else out.limit(limit)
