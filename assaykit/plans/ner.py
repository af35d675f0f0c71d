"""Entity recognition of documents from text to normal forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import entities, iob
from assaykit.operators.tagger import TagModel, gazetteer_tags, tag_tokens
from assaykit.streaming.entities import gazetteer_column


#: Most rows of a gazetteer that is part of the plan.
FEW = 64


def paired_sentences(docs: DataFrame, process: Callable[..., Column] = tx.process) -> DataFrame:
    """(doc_id, sent_id, _p array<struct(tok, raw)>): tokens as the tagger sees them, and with their numbers as written."""
    sents = docs.select("doc_id", F.posexplode(tx.tokenize(F.col("text"))).alias("sent_id", "_t"))
    if process is tx.process:
        return sents.select("doc_id", "sent_id", tx.processed_pairs(F.col("_t")).alias("_p"))
    both = F.zip_with(process(F.col("_t"))["tokens"], process(F.col("_t"), convert_num=False)["tokens"], lambda a, b: F.struct(a.alias("tok"), b.alias("raw")))
    return sents.select("doc_id", "sent_id", both.alias("_p"))


def processed_tokens(docs: DataFrame, process: Callable[..., Column] = tx.process) -> DataFrame:
    """(doc_id, sent_id, pos, tok, raw): the rows of ``paired_sentences`` token by token."""
    return paired_sentences(docs, process).select("doc_id", "sent_id", F.posexplode("_p").alias("pos", "_p")).select("doc_id", "sent_id", "pos", "_p.tok", "_p.raw")


@dataclass(frozen=True)
class Tagger:
    """Tags documents by a trained model, or by a gazetteer (tok, type); ``simple`` merges property tags."""

    model: TagModel | None = None
    gazetteer: DataFrame | None = None
    simple: bool = False
    process: Callable[..., Column] = tx.process

    def as_iob(self, docs: DataFrame) -> DataFrame:
        tokens = processed_tokens(docs, self.process)
        if self.model is not None:
            out = tag_tokens(tokens, self.model, "raw")
        else:
            out = gazetteer_tags(tokens, self.gazetteer).select("doc_id", "sent_id", "pos", F.col("raw").alias("tok"), "tag")
        return iob.simplify_properties(out) if self.simple else out

    def as_sentences(self, docs: DataFrame) -> DataFrame | None:
        """(doc_id, sent_id, tokens, tags) by a gazetteer of at most ``FEW`` rows; None if there is another tagger."""
        if self.model is not None or self.simple:
            return None
        known = self.gazetteer.groupBy("tok").agg(F.min("type").alias("type")).limit(FEW + 1).collect()
        if not 0 < len(known) <= FEW or any(r.tok is None or r.type is None for r in known):
            return None
        pairs = paired_sentences(docs, self.process).select("doc_id", "sent_id", F.col("_p.tok").alias("seen"), F.col("_p.raw").alias("tokens"))
        return pairs.select("doc_id", "sent_id", "tokens", gazetteer_column(F.col("seen"), {r.tok: r.type for r in known}).alias("tags"))

    def as_concatenated(self, docs: DataFrame, compat: bool = False) -> DataFrame:
        rows = None if compat else self.as_sentences(docs)
        if rows is not None:
            return iob.concatenate_rows(rows)
        return iob.concatenate(self.as_iob(docs), compat)

    def as_summary(self, docs: DataFrame) -> DataFrame:
        return iob.summary_documents(self.as_iob(docs))

    def as_normalized(self, docs: DataFrame, forms: DataFrame, lookup: DataFrame) -> DataFrame:
        """Normal forms of all entities; those are computed once, as several steps read them."""
        found = self.as_concatenated(docs).persist(StorageLevel.DISK_ONLY)
        found.count()  # else stages that start together wait for each other's blocks with all cores
        return entities.normalize_documents(found, docs, forms, lookup)
