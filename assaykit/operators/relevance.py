"""TF-IDF features and a linear relevance classifier."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators.lookup import lookup_join


def preprocess(text: Column) -> Column:
    """Processed tokens of a text, its sentences joined."""
    return tx.processed_tokens(tx.tokenize(text, keep_sentences=False))


def tf_idf(tokens: DataFrame, column: str = "tok", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, tok, tf, df, weight): raw counts times ln((1 + n) / (1 + df)) + 1, each document of length 1.

    Counts are combined before they are shuffled; a document's length is a window over its
    distinct words, so weights are computed once.
    """
    own = tokens.where(~F.col(column).isin(*stop_words)) if stop_words else tokens
    tf = own.groupBy("doc_id", F.col(column).alias("tok")).agg(F.count("*").alias("tf")).persist(StorageLevel.DISK_ONLY)
    n = tf.select("doc_id").distinct().count()
    df = tf.groupBy("tok").agg(F.count("*").alias("df"))
    raw = lookup_join(tf, df, "tok", "inner").withColumn("_w", F.col("tf") * (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "tok", "tf", "df", (F.col("_w") / length).alias("weight"))


def pipeline(vocabulary: int = 1 << 16, regularization: float = 0.01) -> Pipeline:
    """Tokens (array column ``tokens``) to a probability of ``label``."""
    return Pipeline(
        stages=[
            StopWordsRemover(inputCol="tokens", outputCol="_kept"),
            CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=vocabulary),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
            LogisticRegression(regParam=regularization, maxIter=30),
        ]
    )


def train(labelled: DataFrame, folds: int | None = None, **options) -> tuple[PipelineModel | CrossValidatorModel, float | None]:
    """The model of (text, label), and the mean area under ROC over ``folds`` if given."""
    # every stage of the pipeline reads the tokens again
    rows = labelled.select(preprocess(F.col("text")).alias("tokens"), F.col("label").cast("double").alias("label")).persist(StorageLevel.DISK_ONLY)
    try:
        if folds is None:
            return pipeline(**options).fit(rows), None
        cv = CrossValidator(estimator=pipeline(**options), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=7)
        model = cv.fit(rows)
        return model, float(model.avgMetrics[0])
    finally:
        rows.unpersist()


def classify(docs: DataFrame, model, decision_boundary: float = 0.5, strict: bool = True) -> DataFrame:
    """``docs`` with probability and relevant: 1 if it is above the boundary, or equals it too unless ``strict``."""
    rows = docs.withColumn("tokens", preprocess(F.col("text")))
    p = vector_to_array(F.col("probability"))[1]
    out = model.transform(rows).withColumn("_p", p)
    hit = F.col("_p") > decision_boundary if strict else F.col("_p") >= decision_boundary
    return out.select(*docs.columns, F.col("_p").alias("probability"), hit.cast("int").alias("relevant"))


def classify_one(docs: DataFrame, model, decision_boundary: float = 0.5) -> DataFrame:
    """The same with documents at the boundary relevant."""
    return classify(docs, model, decision_boundary, strict=False)


def labelled_set(annotations: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Annotations with their entries' columns, one row per key: the entry first in order of its text."""
    first = entries.groupBy(key).agg(*[F.min_by(c, "text").alias(c) for c in entries.columns if c != key])
    return annotations.dropDuplicates([key]).join(first, key)
