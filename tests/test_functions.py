"""Goldens of text, formula, stoichiometry and material-string functions."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions import compounds as cp
from assaykit.functions import formula as fm
from assaykit.functions import lexicon as lx
from assaykit.functions import material as mt
from assaykit.functions import symbolic as sy
from assaykit.functions import text as tx


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_numbers(spark):
    good, bad = ["-5", "-5.5", "123.4", "1,000,000"], ["not a number", "with23numbers", "23.54b", "-23a", ""]
    assert column(spark, good + bad, tx.is_number) == [True] * 4 + [False] * 5


def test_simple_formulas(spark):
    good, bad = ["CoO", "H2O", "C(OH)2", "C(OH)2Si", "Ni0.5(CO)2", "O2"], ["Ad2Al", "123", "some other text", "Ni0.5(CO)2)", "IV", "Fe(II)", "BN", ""]
    assert column(spark, good + bad, fm.is_simple_formula) == [True] * 6 + [False] * 8


def test_normal_forms(spark):
    given = {"SiO2": "O2Si", "Ni(CO)4": "C4NiO4", "Ni(CO)4SiO2": "C4NiO6Si", "Li2(FePO4)2": "FeLiO4P", "Sr(Zr0.5Ti0.5)O3": "O6Sr2TiZr", "Ni0.5Fe0.5": "FeNi", "Al1O1.5": "Al2O3", "C0.04Al0.02O0.5": "AlC2O25", "text": "text"}
    assert column(spark, list(given), fm.normalized_formula) == list(given.values())


def test_tolerant_gcd(spark):
    assert column(spark, ["A0.3333B0.6667"], lambda v: fm.integer_formula(fm.parse(v))) == ["AB2"]


def test_reduced_and_alphabetized(spark):
    assert column(spark, ["O2", "O4", "Fe2O4", "Xx2O", "(Fe", "SrZrO3"], fm.reduced_formula) == ["O2", "O2", "FeO2", None, None, "O3SrZr"]
    assert column(spark, ["SrZrO3"], fm.alphabetize) == ["O3SrZr"]


def test_parentheses(spark):
    assert column(spark, ["(a)", "(a", "a)(", ""], fm.parentheses_balanced) == [True, False, False, True]
    assert column(spark, ["[FeO]", "Fe(OH", "FeO)2", "(FeO)2"], fm.check_parentheses) == ["FeO", "Fe(OH)", "(FeO)2", "(FeO)2"]
    assert column(spark, ["Fe( O H )2 x"], fm.combine_parts) == ["Fe(OH)2 x"]


def test_null_passes_through(spark):
    for f in (fm.parse, fm.normalized_formula, fm.reduced_formula, fm.check_parentheses, tx.tokenize, mt.cleanup_name, mt.formula_from_name, tx.emojify):
        assert column(spark, [None], f) == [None], f


def test_process_sentence(spark):
    one = "We measured 100 materials , including Ni(CO)4 and obtained very high Thermoelectric Figures of merit ZT ."
    got = column(spark, [one], lambda v: tx.process(F.split(v, " ")))[0]
    assert got.tokens == "we measured <nUm> materials , including C4NiO4 and obtained very high thermoelectric figures of merit ZT .".split()
    assert [tuple(m) for m in got.materials] == [("Ni(CO)4", "C4NiO4")]
    bare = column(spark, [one], lambda v: tx.process(F.split(v, " "), exclude_punct=True, convert_num=False, normalize_materials=False))[0].tokens
    assert bare == "we measured 100 materials including Ni(CO)4 and obtained very high thermoelectric figures of merit ZT".split()


def test_split_sentence(spark):
    got = column(spark, ["Fe(II) was oxidized to obtain 5mol. Ferrous Oxide"], lambda v: tx.split_sentence(F.split(v, " ")))[0]
    assert got.tokens == ["Fe", "(II)", "was", "oxidized", "to", "obtain", "5", "mol.", "Ferrous", "Oxide"]
    assert got.split_at == [0, 5]


def test_directions_stay(spark):
    assert column(spark, ["( 111 )", "111 )", "〈 110 〉"], lambda v: F.array_join(tx.process(F.split(v, " "))["tokens"], " ")) == ["( 111 )", "<nUm> )", "〈 110 〉"]


def test_phrases(spark):
    known = F.array(*[F.lit(x) for x in ("thermoelectric_figure", "of_merit", "thermoelectric_figure_of_merit")])
    text = ["the thermoelectric figure of merit is unknown ."]
    assert column(spark, text, lambda v: tx.merge_phrases(F.split(v, " "), known, 1))[0] == ["the", "thermoelectric_figure", "of_merit", "is", "unknown", "."]
    assert column(spark, text, lambda v: tx.merge_phrases(F.split(v, " "), known, 2))[0] == ["the", "thermoelectric_figure_of_merit", "is", "unknown", "."]


def test_accents_and_emoji(spark):
    assert column(spark, ["Néel", "é", "Straße"], tx.remove_accent) == ["Neel", "é", "Strasse"]
    assert column(spark, ["SiO2Cl", "LaSr"], lambda v: tx.unemojify(tx.emojify(v))) == ["SiO2Cl", "LaSr"]


def test_lexicon_sizes():
    assert len(lx.ELEMENTS) == 119 and len(lx.UNITS) == 192 and len(lx.NOT_MATERIALS) == 72
    assert len(lx.ions()["anion"]) > 90 and len(lx.compounds()) > 300 and len(lx.abbreviations()) > 50
    assert len(set(lx.emoji().values())) == len(lx.ELEMENTS) and all(len(e) == 1 for e in lx.emoji().values())
    assert lx.ions()["anion"]["sulfate"] == {"symbol": "SO4", "atoms": 5, "charges": [2]} and lx.ions()["cation"]["ammonium"]["atoms"] == 5


@pytest.mark.parametrize(
    "expression,shown",
    [("1-x", "1-x"), ("-x+1", "1-x"), ("2(1-x)/4", "0.5-0.5x"), ("0.5+0.25", "0.75"), ("2x", "2x"), ("x*y", None), ("1-", None), ("__import__('os')", None), ("1/0", None)],
)
def test_simplify(expression, shown):
    assert sy.simplify(expression) == shown


def test_structures():
    s = sy.structure("BaxSr(1-x)TiO3")
    assert s["composition"] == {"Ba": "x", "Sr": "1-x", "Ti": "1", "O": "3"} and s["fraction_vars"] == ["x"]
    assert sy.structure("(A,B)TiO3")["element_vars"] == {"M": ["A", "B"]}
    assert sy.structure("RE2O3")["composition"] == {"O": "3", "RE": "2"}
    assert sy.structure("La1-xSrxMnO3-δ")["oxygen_deficiency"] == "-"
    assert sy.structure("")["composition"] == {}


def test_compounds():
    assert cp.split_compounds("(1-x)Pb(Zr0.5Ti0.5)O3-xBaTiO3") == [("Pb(Zr0.5Ti0.5)O3", "1-x"), ("BaTiO3", "x")]
    assert cp.split_compounds("CaCl2·2H2O") == [("CaCl2", "1"), ("H2O", "2")]
    assert cp.mixture("0.5Al2O3-0.5ZrO2")["ZrO2"]["fraction"] == "0.5"
    assert cp.split_compounds("La1-xSrxMnO3") == [("La1-xSrxMnO3", "1")]
    assert cp.chemical_structure("α-Fe2O3")["phase"] == "α"


def test_names(spark):
    given = {"iron (III) oxide": "Fe2O3", "calcium nitrate tetrahydrate": "Ca(NO3)2·4H2O", "sodium chloride": "NaCl", "ammonium sulfate": "(NH4)2SO4", "lead zirconate titanate": None, "": None}
    assert column(spark, list(given), mt.formula_from_name) == list(given.values())


def test_additives(spark):
    rows = column(spark, ["Nb-doped SrTiO3", "TiO2 doped with Nb", "Al2O3:Cr", "SrTiO3", "ZnO - 5 mol% Al"], mt.separate_additives)
    assert [(r.material, r.additives) for r in rows] == [("SrTiO3", ["Nb"]), ("TiO2", ["Nb"]), ("Al2O3", ["Cr"]), ("SrTiO3", []), ("ZnO", ["Al"])]


def test_parsed_materials(spark):
    df = spark.createDataFrame([("Nb0.05-doped SrTi0.95O3",), ("CaCl2 · 2H2O",), ("A + B → C",), (None,)], "s string")
    got = {r.s: r.material for r in cp.parse_materials(df, "s").collect()}
    assert got["Nb0.05-doped SrTi0.95O3"].material_formula == "Nb0.05SrTi0.95O3"
    assert got["CaCl2 · 2H2O"].material_formula == "CaCl2·2H2O"
    assert got["A + B → C"].material_formula is None and got[None].material_formula is None


def test_values(spark):
    v = lambda s: spark.range(1).select(mt.stoichiometric_values(F.lit("x"), F.lit(s)).alias("v")).first().v
    assert v("x = 0.25, 0.5 and 1.").values == [0.25, 0.5, 1.0] and v("x = 1/4, 1/2)").values == [0.25, 0.5]
    assert v("x ranging\tfrom 0.1\nto\t0.3").max == 0.3 and v("(x = 0.25, 0.5)").values == [0.25, 0.5]
    assert v("for x = 0.1-0.3)").mode == "range" and v("0 < x < 0.5 ,").max == 0.5 and v("nothing").values == []
    e = spark.range(1).select(mt.element_values(F.lit("A"), F.lit("AO2 (A = Ti4+, Zr, foo)")).alias("v")).first().v
    assert e == ["Ti", "Zr"]
