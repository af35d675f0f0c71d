"""Search in word vectors: means, signed queries, nearest neighbours and formulas.

Queries and their results are small; the vectors are scanned once, their products computed
in the JVM, and the best ``k`` kept by a bounded heap in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import formula as fm
from assaykit.functions.lexicon import ELEMENTS, NOT_MATERIALS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    return fm.let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def _by_dimension(vectors: DataFrame, by: tuple[str, ...], fold: Column) -> DataFrame:
    """One vector per group: ``fold`` of ``v`` at each dimension; partial results are combined before the shuffle."""
    at = vectors.select(*by, F.posexplode("_vec").alias("_d", "v"))
    per = at.groupBy(*by, "_d").agg(fold.alias("_v"))
    grouped = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_d", "_v"))).alias("_all"))
    return grouped.select(*by, F.transform("_all", lambda x: x["_v"]).alias("vec"))


def mean_embedding(words: DataFrame, vectors: DataFrame, by: tuple[str, ...] = (), normalized: bool = True) -> DataFrame:
    """(by..., vec): the mean of the (unit) vectors of words in (word, vec), again of length 1 if ``normalized``.

    Words without a vector are left out; a group of none has no row (``or_zero`` gives it one).
    """
    known = words.join(vectors, "word")
    got = _by_dimension(known.withColumn("_vec", unit(F.col("vec")) if normalized else F.col("vec")).drop("vec"), by, F.avg("v"))
    return got.withColumn("vec", unit(F.col("vec"))) if normalized else got


def or_zero(groups: DataFrame, means: DataFrame, by: str, dimensions: int) -> DataFrame:
    return groups.select(by).distinct().join(means, by, "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dimensions)))


def signed_query(vectors: DataFrame, positive: list, negative: list = (), key: str = "word") -> DataFrame:
    """(vec): the unit sum of the positive keys' unit vectors less the negative ones'."""
    sign = F.when(F.col(key).isin(*positive), F.lit(1.0)).otherwise(F.lit(-1.0))
    own = vectors.where(F.col(key).isin(*positive, *negative)).select(F.transform(unit(F.col("vec")), lambda x: x * sign).alias("_vec"))
    return _by_dimension(own, (), F.sum("v")).withColumn("vec", unit(F.col("vec")))


def query_vector(vectors: DataFrame, positive: list, negative: list = (), key: str = "word") -> Column:
    """The signed query as a literal: one vector, looked up when the plan is made.  No known key: no vector (null)."""
    row = signed_query(vectors, positive, negative, key).first()
    return F.lit(None).cast("array<double>") if row is None else F.lit(row.vec)


def close_words(vectors: DataFrame, positive: list, negative: list = (), top_k: int | None = 8, exclude_self: bool = True, key: str = "word") -> DataFrame:
    """(key, similarity): keys by cosine to the signed query, the best first; ``top_k`` None: all."""
    query = query_vector(vectors, positive, negative, key)
    scored = vectors.select(key, dot(unit(F.col("vec")), query).alias("similarity"))
    if exclude_self:
        scored = scored.where(~F.col(key).isin(*positive, *negative))
    out = scored.orderBy(F.desc("similarity"), key)
    return out if top_k is None else out.limit(top_k)


def formula_totals(counts: DataFrame) -> DataFrame:
    """(formula, total) of (formula, surface, cnt), known abbreviations left out."""
    return counts.where(~F.col("formula").isin(*NOT_MATERIALS)).groupBy("formula").agg(F.sum("cnt").alias("total"))


def most_common_form(counts: DataFrame) -> DataFrame:
    """(formula, form, total): an element's symbol itself, else the most frequent surface, the first of equals."""
    best = F.max_by("surface", F.struct("cnt", F.transform(F.split("surface", ""), lambda c: -F.ascii(c)), -F.length("surface")))
    got = counts.where(~F.col("formula").isin(*NOT_MATERIALS)).groupBy("formula").agg(best.alias("_best"), F.sum("cnt").alias("total"))
    return got.select("formula", F.when(F.col("formula").isin(*ELEMENTS), F.col("formula")).otherwise(F.col("_best")).alias("form"), "total")


def similar_materials(vectors: DataFrame, totals: DataFrame, positive: list, negative: list = (), min_count: int = 3) -> DataFrame:
    """(word, similarity, total): formulas mentioned more than ``min_count`` times, by cosine to the query, all of them."""
    query = query_vector(vectors, positive, negative)
    frequent = totals.where(F.col("total") > min_count).select(F.col("formula").alias("word"), "total")
    return (
        vectors.join(frequent, "word").select("word", dot(unit(F.col("vec")), query).alias("similarity"), "total").orderBy(F.desc("similarity"), "word")
    )


def has_elements(formula: Column, plus: list[str], minus: list[str]) -> Column:
    """Whether a formula has any of ``plus`` (all formulas if that is empty) and none of ``minus``; elements in both count in neither."""
    both = set(plus) & set(minus)
    plus, minus = [e for e in plus if e not in both], [e for e in minus if e not in both]
    own = F.regexp_extract_all(formula, F.lit("[A-Z][a-z]?"), F.lit(0))
    any_of = lambda es: F.arrays_overlap(own, F.array(*[F.lit(e) for e in es]))
    return (any_of(plus) if plus else F.lit(True)) & (~any_of(minus) if minus else F.lit(True))


def filter_by_elements(scored: DataFrame, plus: list[str] = (), minus: list[str] = (), top: int = 50, column: str = "formula", score: str = "score") -> DataFrame:
    return scored.where(has_elements(F.col(column), list(plus), list(minus))).orderBy(F.desc(score), column).limit(top)


def mentioned_with(tokens: DataFrame, variations: list[str], words: list[str]) -> DataFrame:
    """(n_documents, mentioned): documents that have any of the variations and any of the words."""
    flags = tokens.groupBy("doc_id").agg(F.max(F.col("tok").isin(*variations)).alias("a"), F.max(F.col("tok").isin(*words)).alias("b"))
    n = flags.agg(F.count(F.when(F.col("a") & F.col("b"), 1)).alias("n_documents"))
    return n.withColumn("mentioned", F.col("n_documents") > 0)


def trimmed_export(vocab: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """(tok, idx, vec): the vector of every vocabulary word, zeros where there is none, in the order of idx."""
    zero = F.array_repeat(F.lit(0.0), dimensions)
    doubles = F.col("vec").cast("array<double>")
    return vocab.join(vectors.select(F.col("word").alias("tok"), doubles.alias("vec")), "tok", "left").select("tok", "idx", F.coalesce("vec", zero).alias("vec")).orderBy("idx")
