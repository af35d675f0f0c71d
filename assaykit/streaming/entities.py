"""Entities of document streams: stateless tagging, and counts by window with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.functions.formula import let
from assaykit.functions.lexicon import literal_map
from assaykit.operators.iob import concatenate_array


def gazetteer_column(tokens: Column, gazetteer: dict[str, str]) -> Column:
    """Tags of a token array by a word -> type dictionary; the dictionary is part of the plan, so of a model's size."""
    types = F.transform(tokens, lambda t: F.try_element_at(literal_map(gazetteer), t))

    def tags(own: Column) -> Column:
        return F.transform(own, lambda g, i: F.when(g.isNull(), F.lit("O")).otherwise(F.concat(F.when((i > 0) & g.eqNullSafe(F.get(own, i - 1)), F.lit("I-")).otherwise(F.lit("B-")), g)))

    return let(types, tags)


def _typed(tokens: Column, gazetteer: dict[str, str]) -> Column:
    """array<struct(tok, tag)>: the tokens that ``gazetteer_column`` gives a tag other than O."""
    kind = lambda x: F.try_element_at(literal_map(gazetteer), x["tok"])

    def tags(own: Column) -> Column:
        def tag(x: Column, j: Column) -> Column:
            before = F.get(own, j - 1)
            inside = F.coalesce((before["i"] == x["i"] - 1) & (kind(before) == kind(x)), F.lit(False))
            return F.struct(x["tok"].alias("tok"), F.concat(F.when(inside, F.lit("I-")).otherwise(F.lit("B-")), kind(x)).alias("tag"))

        return F.transform(own, tag)

    known = F.transform(tokens, lambda t, i: F.when(t.isin(*gazetteer), F.struct(i.alias("i"), t.alias("tok"))))
    return let(F.filter(known, lambda x: x.isNotNull()), tags)


def entity_stream(docs: DataFrame, gazetteer: dict[str, str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., entity, type) of a batch or stream with a text column: no state, so any output mode."""
    sents = docs.select(*keep, F.explode(tx.tokenize(F.col("text"))).alias("_t")).select(*keep, tx.processed_tokens(F.col("_t")).alias("_t"))
    # tokens tagged O are left out first: an I stands only after a tag of its type, so no entity is cut or joined
    kept = sents.select(*keep, _typed(F.col("_t"), gazetteer).alias("_p")).where(F.size("_p") > 0)
    found = concatenate_array(F.transform("_p", lambda x: x["tok"]), F.transform("_p", lambda x: x["tag"]))
    return kept.select(*keep, F.explode(found).alias("_e")).select(*keep, "_e.entity", "_e.type")


def windowed_mentions(entities: DataFrame, ts: str = "ts", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, type, mentions): counts per tumbling window; rows later than the watermark are left out."""
    counted = entities.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("window"), "type")
    return counted.agg(F.count("*").alias("mentions"))
