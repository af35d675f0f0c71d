"""Token tables: long form, vocabularies, ids, batches and counts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators.lookup import lookup_join


def explode_tokens(docs: DataFrame, tokens: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., sent_id, pos, tok) of an array of token arrays; numbering starts at 0."""
    sents = docs.select(*keep, F.posexplode(tokens).alias("sent_id", "_tokens"))
    return sents.select(*keep, "sent_id", F.posexplode("_tokens").alias("pos", "tok"))


def token_table(docs: DataFrame, text: str = "text") -> DataFrame:
    return explode_tokens(docs, tx.tokenize(F.col(text)))


def vocabulary(tokens: DataFrame, column: str = "tok") -> DataFrame:
    """Distinct values with ids from 0 in alphabetical order: words, tags or characters alike.

    Ids are ranks within range partitions plus the sizes of those before, so no single task
    sorts the vocabulary.  The ranges are computed once: ranks and sizes are of the same ones.
    """
    ranged = tokens.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    marked = ranged.withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = marked.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    # one row for each partition is broadcast
    return marked.withColumn("_rank", rank).join(F.broadcast(before), "_part").select(column, (F.col("_rank") + F.col("_before")).cast("long").alias("idx"))


def characters(tokens: DataFrame, column: str = "tok") -> DataFrame:
    return vocabulary(tokens.select(F.explode(F.split(column, "")).alias("ch")).where("ch <> ''"), "ch")


def union_vocabularies(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def encode(tokens: DataFrame, vocab: DataFrame, unknown: int | None = None, lowercase: bool = True) -> DataFrame:
    """``tokens`` with word_id of (tok, idx); words not in it get ``unknown``, or are an error if that is None."""
    key = tokens.withColumn("_key", tx.number_word(F.col("tok"), lowercase))
    found = lookup_join(key, vocab.select(F.col("tok").alias("_key"), F.col("idx").alias("_idx")), "_key")
    missing = F.raise_error(F.concat(F.lit("unknown word: "), F.col("_key"))) if unknown is None else F.lit(unknown)
    return found.withColumn("word_id", F.coalesce("_idx", missing.cast("long"))).drop("_key", "_idx")


def encode_characters(tokens: DataFrame, chars: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, char_ids): ids in the order of the word's characters; those not in (ch, idx) are left out."""
    # a vocabulary of characters is bounded: its ids stand at their code points in one literal
    known = {ord(r.ch): r.idx for r in chars.where(F.char_length("ch") == 1).collect()}
    table = F.split(F.lit(",".join(str(known.get(i, "")) for i in range(max(known, default=0) + 1))), ",")
    ids = F.transform(F.split("tok", ""), lambda c: F.when(c != "", F.get(table, F.ascii(c)).try_cast("long")))
    return tokens.select("doc_id", "sent_id", "pos", F.coalesce(F.filter(ids, lambda i: i.isNotNull()), F.array().cast("array<long>")).alias("char_ids"))


def minibatches(rows: DataFrame, order: str, size: int, within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with batch_id: consecutive runs of ``size`` rows in order, the last one shorter.

    Without ``within`` the numbering is global: by range partitions, not by one sort.
    """
    if within:
        return rows.withColumn("batch_id", F.floor((F.row_number().over(Window.partitionBy(*within).orderBy(order)) - 1) / size).cast("long"))
    marked = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = marked.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return marked.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn("batch_id", F.floor((F.col("_rank") + F.col("_before")) / size).cast("long")).drop("_part", "_rank", "_before")


def padded(rows: DataFrame, array: str, batch: str, value: Column) -> DataFrame:
    """``rows`` with the array filled to its batch's greatest length, and n, its own length."""
    longest = rows.groupBy(batch).agg(F.max(F.size(array)).alias("_longest"))
    out = rows.join(longest, batch).withColumn("n", F.size(array))
    return out.withColumn(array, tx.pad(F.col(array), F.col("_longest"), value)).drop("_longest")


def material_counts(mentions: DataFrame) -> DataFrame:
    """(formula, total, forms map<surface, count>) of (formula, surface) rows.

    The map holds a formula's distinct surface forms, counted before they are gathered.
    """
    counts = mentions.groupBy("formula", "surface").agg(F.count("*").alias("cnt"))
    return counts.groupBy("formula").agg(F.sum("cnt").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "cnt")))).alias("forms"))


def upsert(old: DataFrame, new: DataFrame, key: str, override: bool) -> DataFrame:
    """Rows of both by key: the new one where both have it if ``override``, else the old one."""
    first, second = (new, old) if override else (old, new)
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in the order of their key's hash: a random sample that is the same in every run."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)
