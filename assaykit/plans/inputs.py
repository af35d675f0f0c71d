"""Derived tables with chemical content, by the same arithmetic as their SQL forms.

``materials`` gives every part a formula, ``tagged`` every token of the documents an IOB
tag, so that each operator runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METALS = "Li Fe Ti Zn Sr Ba Co Ni Cu Mn"
ANIONS = "O S N Cl F"
TYPES = "APL CMT DSC MAT PRO PUT PVL SMT SPL"
TOKEN = r"[\p{L}]+|[0-9]+|[^\p{L}0-9\s]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from assaykit.deploy import ship

    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows of part in a task: few bytes, but dear expressions.
PART_ROWS = 10_000


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` spread over tasks by its rows: a file of small rows is one split, whose expressions would all run in one task."""
    part = read(spark, sf_dir, "part")
    n = -(-part.count() // PART_ROWS)
    return part.repartition(n, "p_partkey") if n > 1 else part


def _pick(words: str, i: Column) -> Column:
    return F.get(F.split(F.lit(words), " "), i.cast("int"))


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, p_size, formula): flat, nested, decimal and broken formulas, words and numerals by p_partkey."""
    part = parts(spark, sf_dir).select("p_partkey", "p_size")
    k, z = F.col("p_partkey"), F.col("p_size")
    a, b, x = _pick(METALS, k % 10), _pick(METALS, (k / 10).cast("long") % 10), _pick(ANIONS, z % 5)
    s = lambda c: c.cast("string")
    arm = k % 8
    f = (
        F.when(arm == 0, F.concat(a, s(1 + k % 3), x, s(1 + z % 4)))
        .when(arm == 1, F.concat(a, b, x, s(2 + z % 3)))
        .when(arm == 2, F.concat(a, F.lit("("), b, F.lit("O4)"), s(2 + z % 2)))
        .when(arm == 3, F.concat(a, F.lit("0."), s(1 + z % 8), b, F.lit("0."), s(9 - z % 8), x))
        .when(arm == 4, F.concat(a, F.lit("2("), b, F.lit("PO4)"), s(2 + z % 3)))
        .when(arm == 5, F.concat(F.lit("Sr("), a, F.lit("0.5"), b, F.lit("0.5)O3")))
        .when(arm == 6, F.concat(F.lit("sample "), s(k % 97)))
        .otherwise(F.get(F.array(*[F.lit(w) for w in ("IV", "O2", "Ad2Al", "CoO(", "PZT", "H2O", "123", "NaCl")]), ((k / 8).cast("long") % 8).cast("int")))
    )
    return part.withColumn("formula", f)


MATERIALS_SQL = """
mat AS (SELECT p_partkey, p_size, CASE p_partkey % 8
    WHEN 0 THEN a || (1 + p_partkey % 3) || x || (1 + p_size % 4)
    WHEN 1 THEN a || b || x || (2 + p_size % 3)
    WHEN 2 THEN a || '(' || b || 'O4)' || (2 + p_size % 2)
    WHEN 3 THEN a || '0.' || (1 + p_size % 8) || b || '0.' || (9 - p_size % 8) || x
    WHEN 4 THEN a || '2(' || b || 'PO4)' || (2 + p_size % 3)
    WHEN 5 THEN 'Sr(' || a || '0.5' || b || '0.5)O3'
    WHEN 6 THEN 'sample ' || (p_partkey % 97)
    ELSE ['IV', 'O2', 'Ad2Al', 'CoO(', 'PZT', 'H2O', '123', 'NaCl'][(p_partkey // 8) % 8 + 1] END AS formula
  FROM (SELECT p_partkey, p_size, string_split('Li Fe Ti Zn Sr Ba Co Ni Cu Mn', ' ')[p_partkey % 10 + 1] AS a,
               string_split('Li Fe Ti Zn Sr Ba Co Ni Cu Mn', ' ')[(p_partkey // 10) % 10 + 1] AS b, string_split('O S N Cl F', ' ')[p_size % 5 + 1] AS x FROM part))
"""

#: Formulas of one parenthesis at most, read by splitting instead of by a stack.
PARSED_SQL = MATERIALS_SQL + r""",
pieces AS (SELECT *, regexp_extract(formula, '^([^()]*)', 1) AS h, regexp_extract(formula, '\(([^()]*)\)', 1) AS g,
        coalesce(try_cast(regexp_extract(formula, '\)([0-9.]+)', 1) AS DOUBLE), 1) AS m, regexp_extract(formula, '\)[0-9.]*(.*)$', 1) AS t,
        regexp_full_match(formula, '(([A-Z][a-z]?[0-9.]*)|(\(([A-Z][a-z]?[0-9.]*)+\)[0-9.]*))+') AS fine FROM mat),
items AS (
    SELECT p_partkey, unnest(regexp_extract_all(h || t, '[A-Z][a-z]?[0-9.]*')) AS i, 1.0::DOUBLE AS m FROM pieces WHERE fine
    UNION ALL SELECT p_partkey, unnest(regexp_extract_all(g, '[A-Z][a-z]?[0-9.]*')), m FROM pieces WHERE fine),
amounts AS (SELECT p_partkey, regexp_extract(i, '^[A-Z][a-z]?') AS el, sum(m * coalesce(try_cast(regexp_extract(i, '[0-9.]+$') AS DOUBLE), 1)) AS n FROM items GROUP BY ALL),
known AS (SELECT p_partkey, count(*) AS els, bool_and(el IN ('Li', 'Fe', 'Ti', 'Zn', 'Sr', 'Ba', 'Co', 'Ni', 'Cu', 'Mn', 'O', 'S', 'N', 'Cl', 'F', 'P', 'H', 'Na', 'Al', 'I', 'V')) AS ok,
        list_reduce(list(round(n * 1000)::BIGINT), lambda a, b: gcd(a, b)) AS g FROM amounts GROUP BY p_partkey),
canon AS (SELECT p_partkey, els, ok, string_agg(el || CASE WHEN round(n * 1000)::BIGINT // g > 1 THEN (round(n * 1000)::BIGINT // g)::VARCHAR ELSE '' END, '' ORDER BY el) AS c
    FROM amounts JOIN known USING (p_partkey) GROUP BY p_partkey, els, ok)
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_id, pos, tok): words, numbers and signs of each line of every document."""
    docs = read(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    return lines.select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))


def tag_of(tok: Column, pos: Column, shift: int = 0) -> Column:
    n = F.length(tok) + pos % 3 + shift
    kind = _pick(TYPES, (F.length(tok) + (pos / 4).cast("long")) % 9)
    return F.when(n % 4 == 0, F.concat(F.lit("B-"), kind)).when(n % 4 == 1, F.concat(F.lit("I-"), kind)).otherwise("O")


def tagged(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """``tokens`` with tag, a function of length, place and ``shift``."""
    return tokens(spark, sf_dir).withColumn("tag", tag_of(F.col("tok"), F.col("pos"), shift))


def tagged_sentences(spark: SparkSession, sf_dir: str, **shifts: int) -> DataFrame:
    """(doc_id, sent_id, tokens, tags): the rows of ``tagged`` as arrays, one row for every line; each row of documents is a document.

    ``shifts`` names columns of tags and their shifts.
    """
    docs = read(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    rows = lines.select("doc_id", "sent_id", F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    return rows.select("*", *[_tags(F.col("tokens"), shift).alias(name) for name, shift in (shifts or {"tags": 0}).items()])


def _tags(tokens: Column, shift: int) -> Column:
    return F.transform(tokens, lambda t, i: tag_of(t, i, shift))


def tagged_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lengths, tokens, tags): the arrays of ``tagged_sentences`` of a document one after the other, and their lengths."""
    docs = read(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    rows = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))).alias("s"))
    return rows.select("doc_id", F.transform("s", F.size).alias("lengths"), F.flatten("s").alias("tokens"), F.flatten(F.transform("s", lambda s: _tags(s, 0))).alias("tags"))


def tagged_documents(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(doc_id, sentences): the rows of ``tagged`` as array<array<struct(sent_id, pos, tok, tag)>>, one for every line; each row of documents is a document."""
    docs = read(spark, sf_dir, "documents").where(F.col("text").isNotNull())

    def line(text: Column, at: Column) -> Column:
        toks = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
        return F.transform(toks, lambda t, i: F.struct(at.alias("sent_id"), i.alias("pos"), t.alias("tok"), tag_of(t, i, shift).alias("tag")))

    return docs.select("doc_id", F.transform(F.split("text", "\n"), line).alias("sentences"))


TOKENS_SQL = r"""
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS sent_id, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
tok AS (SELECT doc_id, sent_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tok FROM (SELECT doc_id, sent_id, regexp_extract_all(line, '[\p{L}]+|[0-9]+|[^\p{L}0-9\s]') AS t FROM lines))
"""


def tagged_sql(name: str = "tag", shift: int = 0) -> str:
    n = f"((length(tok) + pos % 3 + {shift}) % 4)"
    kind = f"string_split('{TYPES}', ' ')[(length(tok) + pos // 4) % 9 + 1]"
    return f"{name} AS (SELECT *, CASE {n} WHEN 0 THEN 'B-' || {kind} WHEN 1 THEN 'I-' || {kind} ELSE 'O' END AS tag FROM tok)"
