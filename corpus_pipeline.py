"""A training corpus from raw documents, as stages that each apply one operator.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, all but the last with the columns of documents.

In every stage: an empty table gives an empty table; texts count whole, however long; only
doc_id, text and, for the quality rules, lang are read, so further columns may have any names and
are handed on as they are; null doc_ids are rows like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.deploy import shared_folder
from assaykit.llm import decontaminate, quality, simhash, toxicity, vectorpack
from assaykit.llm.common import BATCH_BYTES as BATCH_BYTES
from assaykit.llm.common import id_remainder, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; labels held out for judging the model teach it nothing here either.

    Null and empty texts hold no evidence of toxicity and stay.  Each row is judged for itself:
    repeated rows stay or go together, in their number.  A score that equals the threshold is toxic.
    Without toxic labels nothing goes.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 4) != 2)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts have too few words and go.  Repeated rows stay or go together, in
    their number.  Measures that equal their limits pass.  References are learned from the
    stage's own input; with no language known only the base rules judge.
    """
    small_batches(spark)
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of every group of near-duplicates.

    Texts without words (null, empty) are one group.  Of rows that repeat the least id, the
    one of the least text stays.  Null ids are never the least: such a row stays only if its
    group has no other id, one for each fingerprint.
    """
    small_batches(spark)
    return simhash.dedup(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those mostly made of them go.

    n_chars is counted anew where a text is cut.  Null and empty texts have no words and stay;
    repeated rows are cut alike and stay in their number.  A document of which just half the
    words lie in passages is cut and stays.  Without items all stay as they are.
    """
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of tokenised documents and their places in packed sequences.

    Null and empty texts are one piece of one token.  Repeated rows are packed each.  Equal
    choices of a sequence go to the one opened first.
    """
    small_batches(spark)
    return vectorpack.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("best-fit packing", pack),
]

#: Trained models, XXH64 fingerprints and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the session's shared checkpoint folder.

    What a stage wrote is removed when the next is written; the last of them is what the result reads.
    """
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return STAGES[-1][1](spark, docs, sf_dir)
