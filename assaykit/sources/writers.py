"""Writers: vocabularies, corpora and token collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators.tokens import upsert


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """One word per line in the order of idx, in one file: a vocabulary's size is a model's, not a corpus's."""
    vocab.coalesce(1).sortWithinPartitions("idx").select("tok").write.mode("overwrite").text(path)


def corpus_lines(docs: DataFrame, line_per_abstract: bool = False, split_years: bool = False, keep: tuple[str, ...] = (), **process) -> DataFrame:
    """(keep..., year?, value): processed sentences of title and abstract as lines of tokens, or a line per document."""
    whole = F.concat_ws(". ", *[F.col(c) for c in ("title", "abstract") if c in docs.columns])
    lines = F.transform(tx.tokenize(whole), lambda s: F.array_join(tx.processed_tokens(s, **process), " "))
    value = F.array(F.array_join(lines, " ")) if line_per_abstract else lines
    years = ("year",) if split_years else ()
    return docs.select(*keep, *years, F.explode(value).alias("value")).where("value <> ''")


def write_corpus(docs: DataFrame, path: str, split_years: bool = False, **options) -> None:
    """Text files of corpus lines, in a folder per year if asked."""
    out = corpus_lines(docs, split_years=split_years, **options).write.mode("overwrite")
    (out.partitionBy("year") if split_years else out).text(path)


def tokenized(docs: DataFrame, key: str = "doi", text: str = "text") -> DataFrame:
    """(key, tokens, error): what cannot be tokenised (null text) has null tokens and an error."""
    tokens = tx.tokenize(F.col(text))
    return docs.select(key, tokens.alias("tokens"), F.when(F.col(text).isNull(), F.lit("no text")).alias("error"))


def merge_tokenized(old: DataFrame, docs: DataFrame, key: str = "doi", text: str = "text", override: bool = False) -> DataFrame:
    """The collection after an upsert; without ``override`` documents it has are not tokenised again."""
    todo = docs if override else docs.join(old.select(key), key, "left_anti")
    return upsert(old, tokenized(todo, key, text), key, override)
