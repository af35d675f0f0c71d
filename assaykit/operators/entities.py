"""Normal forms of entities: dictionaries, abbreviations, wildcards and fractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import formula as fm
from assaykit.functions import material as mt
from assaykit.functions import symbolic as sy
from assaykit.functions import text as tx
from assaykit.functions.lexicon import DICTIONARY_TYPES, GREEK, NAMED_MATERIALS
from assaykit.operators.lookup import lookup_join

_FORMULA_LIKE = rf"((?:[A-Z][0-9A-Za-z{GREEK}()+-]*){{2,}})"


def dictionary_normal(entities: DataFrame, forms: DataFrame) -> DataFrame:
    """``entities`` with ``normal``: the form in (type, entity, most_common), found without regard to case, else the entity.

    Only types that have dictionaries are looked up.  Of dictionary rows that differ in
    case only, the last form in alphabetical order holds.
    """
    keyed = forms.where(F.col("type").isin(*DICTIONARY_TYPES)).groupBy("type", F.upper("entity").alias("_key")).agg(F.max("most_common").alias("_form"))
    return lookup_join(entities.withColumn("_key", F.upper("entity")), keyed, ["type", "_key"]).withColumn("normal", F.coalesce("_form", "entity")).drop("_key", "_form")


def abbreviations(materials: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, abbreviation, full, source) for (doc_id, pos, material) and (doc_id, sent_id, sentence).

    An abbreviation is resolved by a material of its document with the same capitals (O
    aside), the last by position; else by the last word with those capitals in the
    document's first sentence that has the abbreviation and such a word; else, if it is a
    chain A-B of resolved ones, by the chain.  Unresolved ones have no row.  Matching is an
    equi-join on the capitals' signature.
    """
    own = materials.select("doc_id", "pos", "material", mt.capital_signature(F.col("material")).alias("sig"), mt.is_abbreviation(F.replace("material", F.lit(" "), F.lit(""))).alias("short"))
    short = own.where("short").groupBy("doc_id", "sig", F.col("material").alias("abbreviation")).agg(F.min("pos").alias("pos"))
    full = own.where("NOT short").groupBy("doc_id", "sig").agg(F.max_by("material", "pos").alias("full"))
    by_entity = short.join(full, ["doc_id", "sig"], "left")
    words = sentences.select("doc_id", "sent_id", "sentence", F.posexplode(F.split("sentence", r"\s+")).alias("at", "word"))
    words = words.withColumn("sig", mt.capital_signature(F.col("word"))).where("sig <> ''")
    open_ = by_entity.where("full IS NULL").select("doc_id", "sig", "abbreviation")
    hits = open_.join(words, ["doc_id", "sig"]).where((F.instr(F.col("sentence"), F.col("abbreviation")) > 0) & (F.col("word") != F.col("abbreviation")))
    first = hits.groupBy("doc_id", "abbreviation").agg(F.max_by("word", F.struct(-F.col("sent_id"), F.col("at"))).alias("word"))
    solved = by_entity.join(first, ["doc_id", "abbreviation"], "left").select(
        "doc_id", "abbreviation", F.coalesce("full", "word").alias("full"), F.when(F.col("full").isNotNull(), "entity").when(F.col("word").isNotNull(), "text").alias("source")
    )
    chains = solved.where(F.col("full").isNull() & F.col("abbreviation").contains("-")).select("doc_id", "abbreviation", F.posexplode(F.split("abbreviation", "-")).alias("i", "part"))
    done = solved.where("full IS NOT NULL")
    parts = chains.join(done.select("doc_id", F.col("abbreviation").alias("part"), F.col("full").alias("of")), ["doc_id", "part"], "left")
    made = parts.groupBy("doc_id", "abbreviation").agg(F.bool_and(F.col("of").isNotNull()).alias("all"), F.array_sort(F.collect_list(F.struct("i", "of"))).alias("of"))
    chain = made.where("all").select("doc_id", "abbreviation", F.array_join(F.transform("of", lambda x: F.concat(F.lit("("), x["of"], F.lit(")"))), "-").alias("full"), F.lit("chain").alias("source"))
    return done.unionByName(chain)


def substitute_abbreviations(materials: DataFrame, solved: DataFrame) -> DataFrame:
    """(doc_id, material): distinct materials, abbreviations written in full."""
    full = solved.select("doc_id", F.col("abbreviation").alias("material"), "full")
    out = materials.select("doc_id", "material").join(full, ["doc_id", "material"], "left").select("doc_id", F.coalesce("full", "material").alias("material"))
    return out.where("material <> ''").distinct()


def wildcards(material: Column, text: Column, variables: Column) -> Column:
    """Reduced formulas with each element variable replaced by each element the text gives it ("AO2 (A = Ti, Zr)")."""
    formula = F.nullif(F.regexp_extract(material, _FORMULA_LIKE, 1), F.lit(""))
    per = F.transform(variables, lambda v: F.transform(mt.element_values(v, text), lambda e: fm.reduced_formula(F.replace(formula, v, e))))
    return F.filter(F.flatten(per), lambda x: x.isNotNull())


def element_variables(material: Column) -> Column:
    """Capitals of a formula that are no element's symbol by themselves or with their small letter."""
    symbols = F.regexp_extract_all(material, F.lit("[A-Z][a-z]?"), F.lit(0))
    heads = F.transform(F.filter(symbols, lambda s: ~fm.is_element(s)), lambda s: F.substring(s, 1, 1))
    return F.array_distinct(F.filter(heads, lambda h: ~fm.is_element(h)))


def _assigned(formula: str | None, variable: str | None, values) -> list[str]:
    if not formula or not variable or values is None:
        return []
    parts = sy.structure(formula)["composition"]
    out = []
    for v in values:
        amounts = {e: sy.evaluate(a, {variable: float(v)}) for e, a in parts.items()}
        if amounts and all(a is not None and a > -1e-9 for a in amounts.values()):
            out.append("".join(f"{e}{a:.6g}" for e, a in amounts.items() if a > 1e-9))
    return out


def _with_values(rows: DataFrame, key: str) -> DataFrame:
    """(key, _i, _f, _out): formulas with a variable's values put in; amounts are evaluated as polynomials, never as code."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [_assigned(*x) for x in zip(f["_f"], f["_v"], f["_values"])]
            yield pd.DataFrame({key: f[key], "_i": f["_i"], "_f": f["_f"], "_out": out})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "_i", "_f", "_v", "_values").mapInPandas(run, f"{key} {kind}, _i int, _f string, _out array<string>")


def fractions(rows: DataFrame, key: str = "mention_id") -> DataFrame:
    """(key, fractions) of (key, material, text): reduced formulas for the values of each amount variable.

    Values come from the text's first sentence that has any.  A formula that lost more than
    one element makes the mention unresolved (no row).
    """
    formula = F.nullif(F.regexp_extract("material", _FORMULA_LIKE, 1), F.lit(""))
    # rows without a variable never reach Python
    maybe = rows.withColumn("_f", formula).where(F.col("_f").rlike(rf"[a-z{GREEK}]")).withColumn("_s", sy.structure_column(F.col("_f")))
    per = maybe.select(key, "text", "_f", F.posexplode("_s.fraction_vars").alias("_i", "_v"))
    found = F.filter(F.transform(tx.sentences(F.col("text")), lambda s: mt.stoichiometric_values(F.col("_v"), F.concat(s, F.lit(" ")))["values"]), lambda v: F.size(v) > 0)
    made = _with_values(per.withColumn("_values", F.get(found, F.lit(0))), key)
    reduced = F.filter(F.transform("_out", lambda f: fm.reduced_formula(f)), lambda f: f.isNotNull())
    n = lambda c: F.size(F.regexp_extract_all(c, F.lit("[A-Z][a-z]?"), F.lit(0)))
    kept = made.withColumn("_r", reduced).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_r"))).alias("_all"), F.first("_f").alias("_f"))
    out = kept.select(key, "_f", F.flatten(F.transform("_all", lambda x: x["_r"])).alias("fractions"))
    return out.where((F.size("fractions") > 0) & ~F.exists("fractions", lambda x: n(x) < n(F.col("_f")) - 1)).select(key, "fractions")


def normalize_materials(mentions: DataFrame, lookup: DataFrame, solved: DataFrame | None = None) -> DataFrame:
    """``mentions`` (mention_id, doc_id, material, text) with ``normal`` array<string> and ``method``.

    The first that applies: named materials stay; a formula is reduced; the lookup table
    (material, formula); an abbreviation (doc_id, abbreviation, full); element wildcards;
    amount variables; else the mention itself.  The Python step sees only mentions that
    all others left open.
    """
    m = mentions.withColumn("material", F.replace("material", F.lit("_"), F.lit(" ")))
    m = m.join(lookup.groupBy("material").agg(F.max("formula").alias("_looked")), "material", "left")
    if solved is not None:
        m = m.join(solved.select("doc_id", F.col("abbreviation").alias("material"), F.col("full").alias("_full")), ["doc_id", "material"], "left")
    else:
        m = m.withColumn("_full", F.lit(None).cast("string"))
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    none = F.lit(None).cast("array<string>")
    wild = wildcards(F.col("material"), F.col("text"), element_variables(F.col("material")))
    steps = [
        (F.when(F.col("material").isin(*NAMED_MATERIALS), F.array("material")).otherwise(none), "named"),
        (one(fm.reduced_formula(F.col("material"))), "formula"),
        (one(F.col("_looked")), "lookup"),
        (one(fm.reduced_formula(F.col("_full"))), "abbreviation"),
        (F.when(F.size(wild) > 0, wild), "wildcard"),
    ]
    tried = F.array(*[F.struct(c.alias("normal"), F.lit(n).alias("method")) for c, n in steps])
    m = m.withColumn("_got", F.get(F.filter(tried, lambda x: x["normal"].isNotNull()), F.lit(0))).drop("_looked", "_full")
    open_ = fractions(m.where("_got IS NULL").select("mention_id", "material", "text"))
    m = m.join(open_, "mention_id", "left")
    normal = F.coalesce("_got.normal", "fractions", F.array("material"))
    method = F.coalesce("_got.method", F.when(F.col("fractions").isNotNull(), F.lit("fraction")), F.lit("identity"))
    return m.withColumns({"normal": normal, "method": method}).drop("_got", "fractions")


def normalize_documents(entities: DataFrame, docs: DataFrame, forms: DataFrame, lookup: DataFrame) -> DataFrame:
    """(doc_id, sent_id, ent_pos, type, entity, normal array, method) of concatenated entities: materials by the cascade, others by dictionary."""
    materials = entities.where("type = 'MAT'").withColumnRenamed("entity", "material")
    text = docs.select("doc_id", "text")
    sents = text.join(materials.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_id", "sentence"))
    numbered = materials.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id", "ent_pos")).alias("pos"), "material")
    solved = abbreviations(numbered, sents)
    # a document's mentions of one material have one normal form: each is looked for once
    once = materials.select("doc_id", "material").distinct().withColumn("mention_id", F.concat_ws(":", "doc_id", "material"))
    known = normalize_materials(once.withColumnRenamed("material", "_as").withColumn("material", F.col("_as")).join(text, "doc_id"), lookup, solved)
    shown = known.select("doc_id", F.col("_as").alias("material"), F.col("material").alias("entity"), "normal", "method")
    mats = materials.join(shown, ["doc_id", "material"])
    others = dictionary_normal(entities.where("type <> 'MAT'"), forms).withColumns({"normal": F.array("normal"), "method": F.lit("dictionary")})
    cols = ["doc_id", "sent_id", "ent_pos", "type", "entity", "normal", "method"]
    return mats.select(*cols).unionByName(others.select(*cols))
