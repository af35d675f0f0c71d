"""Material strings: cleaning, names, additives, abbreviations and values of variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions import formula as fm
from assaykit.functions.lexicon import (
    ELEMENTS, GREEK, NAME_TO_SYMBOL, NUMBER_PREFIXES, ROMAN, SYMBOL_TO_NAME, abbreviations, compounds, ions, is_in, literal_array, literal_map,
)

_TYPOS = (
    ("oxyde", "oxide"), ("luminum", "luminium"), ("magneshium", "magnesium"), ("stanate", "stannate"), ("sulph", "sulf"), ("butir", "butyr"), ("buter", "butyr"),
    ("butly", "butyl"), ("ehtyl", "ethyl"), ("ethly", "ethyl"), ("phio", "thio"), ("uim", "ium"), ("uium", "ium"), ("butryal", "butyral"), ("ooper", "opper"),
    ("europeam", "europium"), ("siliminite", "sillimanite"), ("acethylene", "acetylene"), ("iso-pro", "isopro"), ("lathanum", "lanthanum"), ("sodiam", "sodium"),
    ("acac", "CH3COCHCOCH3"), ("Abstract ", ""), ("anhydrous", ""), ("Anhydrous", ""), ("bulk", ""), ("Bulk", ""), ("()", ""),
)
_TRASH = ("ceramic", "coat", "crystal", "earth", "glass", "micro", "nano", "particl", "powder", "rear")
_SUPPLIERS = r"[(](?:⩾?9[0-9]|＞99|Acr|Aladdin|Aldrich|Alfa|A[.]G|A[.]R|AR[)]|Fuchen|Furuuchi|Koj|Sho|Sigma|x).*$"
_ADDED = "(?:activated|added|coated|doped|modified|stabilized)"


def cleanup_name(name: Column) -> Column:
    """A material string without typographic variants, phases, suppliers, filler words and typos; null if nothing is left.

    Reaction equations (arrows) are no material and give null.
    """
    s = F.regexp_replace(name, r"\s*[-­‐-―−]\s*", "-")
    s = F.regexp_replace(s, r"\s*[+]\s*", "+")
    s = F.regexp_replace(s, "[ ​ #$!@©®Ⓡ]", "")
    s = F.regexp_replace(s, "[*×•⁎∙⋅﹒･・⍰]", "·")
    s = F.regexp_replace(s, r"\s*·\s*", "·")
    s = F.replace(s, F.lit("∕"), F.lit("/"))
    s = F.regexp_replace(s, rf"\s*([-+±])\s*[{GREEK}]", "$1δ")
    s = F.regexp_replace(s, r"[(](?:s|l|g|aq)[)]", "")
    s = F.regexp_replace(s, rf"[A-Za-z-]*(?i:{'|'.join(_TRASH)})[A-Za-z-]*", "")
    s = F.regexp_replace(s, r"[(]?[0-9.]*\s*[⩽≤<]?\s*[xy]?\s*[⩽≤<=]\s*[0-9.-]*[)]?", "")
    s = F.regexp_replace(s, _SUPPLIERS, "")
    for typo, right in _TYPOS:
        s = F.replace(s, F.lit(typo), F.lit(right))
    s = F.regexp_replace(s, r"/C$", "")
    s = F.regexp_replace(s, r"poly[\s-](?=[a-z])", "poly")
    s = F.regexp_replace(s, r"([a-z])([(][IV,]+[)])(?=.*\s)", "$1 $2")
    s = fm.let(s, fm.check_parentheses)
    s = F.regexp_replace(F.regexp_replace(s, r"^[) -]+", ""), r"[( ,.:;±/∓-]+$", "")
    s = F.regexp_replace(s, r"\s([0-9.]*H2O)$", "·$1")
    s = fm.let(fm.let(s, fm.combine_parts), lambda c: F.trim(fm.check_parentheses(c)))
    none = F.lit(None).cast("string")
    return F.when(
        ~name.rlike("[→⟶↑↓↔⇌⇒⇔⟹]"), fm.let(s, lambda c: F.when(~c.rlike(r"\p{L}") | (F.length(c) == 1) & ~is_in(c, ELEMENTS), none).otherwise(c))
    )


# names --------------------------------------------------------------------------------


def _ion_map(kind: str) -> Column:
    return literal_map({n: f"{x['symbol']}|{x['atoms']}|{','.join(map(str, x['charges']))}" for n, x in ions()[kind].items()})


def ion(name: Column, kind: str) -> Column:
    """struct(symbol, atoms, charges) of an ion's name, null if unknown."""

    def of(row: Column) -> Column:
        return F.when(
            row.isNotNull(), F.struct(row[0].alias("symbol"), row[1].cast("int").alias("atoms"), F.split(row[2], ",").cast("array<int>").alias("charges"))
        )

    return fm.let(F.split(F.try_element_at(_ion_map(kind), name), "[|]"), of)


def get_element(name: Column) -> Column:
    """An ion's symbol: an anion's first."""
    return F.coalesce(ion(name, "anion")["symbol"], ion(name, "cation")["symbol"])


def number_prefix(name: Column) -> Column:
    """struct(prefix, number, rest): the longest numeral a name starts with; number 0 without one.  A rest of "xide" is oxide."""
    prefixes = "|".join(sorted(NUMBER_PREFIXES, key=lambda p: (-len(p), p)))
    p = F.regexp_extract(F.lower(name), f"^({prefixes})", 1)
    rest = F.regexp_replace(name.substr(F.length(p) + 1, F.length(name)), "^-+", "")
    n = F.coalesce(F.try_element_at(literal_map({k: str(v) for k, v in NUMBER_PREFIXES.items()}), p).cast("int"), F.lit(0))
    return F.struct(p.alias("prefix"), n.alias("number"), F.when(rest == "xide", F.lit("oxide")).otherwise(rest).alias("rest"))


def roman(numeral: Column) -> Column:
    return F.try_element_at(literal_map({k: str(v) for k, v in ROMAN.items()}), numeral).cast("int")


def build_formula(cation: Column, anion: Column, cation_number: Column, anion_number: Column) -> Column:
    """The formula of two ions by charge balance, or by the numerals of their names (0: none)."""
    vc, va = cation["charges"][0], anion["charges"][0]
    common = fm.lcm(vc, va)
    by_anion = F.coalesce(
        F.get(F.filter(F.transform(cation["charges"], lambda v: F.floor(anion_number * va / v)), lambda n: n > 0), F.lit(0)),
        F.lit(0),
    )
    both = (cation_number > 0) & (anion_number > 0)
    n_c = F.when(cation_number > 0, cation_number).when(anion_number > 0, by_anion).otherwise(F.floor(common / vc))
    n_a = F.when(both, anion_number).when(cation_number > 0, F.floor(cation_number * vc / va)).when(anion_number > 0, anion_number).otherwise(F.floor(common / va))

    def part(i: Column, n: Column) -> Column:
        wrapped = F.when((n > 1) & (i["atoms"] > 1), F.concat(F.lit("("), i["symbol"], F.lit(")"))).otherwise(i["symbol"])
        return F.concat(wrapped, fm.cast_stoichiometry(n))

    return F.concat(part(cation, n_c), part(anion, n_a))


def _named(name: Column, kind: str) -> Column:
    """struct(ion, number) of a name with or without a numeral; the ion is null if unknown."""

    def of(direct: Column) -> Column:
        rest = fm.let(number_prefix(name), lambda p: F.struct(ion(p["rest"], kind).alias("ion"), p["number"].alias("number")))
        return F.when(direct.isNotNull(), F.struct(direct.alias("ion"), F.lit(0).alias("number"))).otherwise(rest)

    return fm.let(ion(name, kind), of)


def formula_from_name(name: Column) -> Column:
    """The formula of a simple name: cation, (valency), anion, hydrate; null if it is no such name."""
    spaced = F.regexp_replace(name, r"([(][IVX]+[)])", " $1 ")
    return fm.let(F.filter(F.split(spaced, r"\s+"), lambda p: p != ""), _formula_of_parts)


def _formula_of_parts(parts: Column) -> Column:
    def is_roman(p: Column) -> Column:
        return is_in(F.btrim(p, F.lit("()")), tuple(ROMAN))

    valency = F.array_max(F.transform(F.filter(parts, is_roman), lambda p: roman(F.btrim(p, F.lit("()")))))
    hydrate = F.lower(F.get(F.filter(parts, lambda p: F.lower(p).contains("hydrate")), F.lit(0)))
    kept = F.transform(F.filter(parts, lambda p: ~is_roman(p) & ~F.lower(p).contains("hydrate")), lambda p: F.btrim(p, F.lit(" -")))

    def water(n: Column) -> Column:
        return F.concat(F.lit("·"), F.when(n > 1, n.cast("string")).otherwise(F.lit("")), F.lit("H2O"))

    hydrated = F.when(hydrate.isNull(), F.lit("")).otherwise(fm.let(number_prefix(hydrate)["number"], water))

    def of(terms: Column) -> Column:
        n = F.size(terms)
        hydrogen = (n == 3) & F.lower(F.get(terms, F.lit(1))).contains("hydrogen")
        last = F.rtrim(F.lower(F.get(terms, n - 1)), F.lit("s"))
        anion = F.when(hydrogen, F.concat_ws(" ", F.lower(F.get(terms, F.lit(1))), last)).otherwise(last)
        first = F.get(terms, F.lit(0))
        cation = F.coalesce(F.try_element_at(literal_map(SYMBOL_TO_NAME), first), F.lower(first))

        def with_valency(c: Column) -> Column:
            given = F.struct(c["symbol"].alias("symbol"), c["atoms"].alias("atoms"), F.array(valency).alias("charges"))
            return F.when((F.size(c["charges"]) > 1) & valency.isNotNull(), given).otherwise(c)

        def built(x: Column) -> Column:
            known = x["c"]["ion"].isNotNull() & x["a"]["ion"].isNotNull()
            return F.when(known & ((n == 2) | hydrogen), F.concat(build_formula(with_valency(x["c"]["ion"]), x["a"]["ion"], x["c"]["number"], x["a"]["number"]), hydrated))

        whole = F.lower(F.array_join(terms, " "))
        both = F.struct(_named(cation, "cation").alias("c"), _named(anion, "anion").alias("a"))
        return F.coalesce(ion(whole, "anion")["symbol"], ion(whole, "cation")["symbol"], fm.let(both, built))

    return fm.let(kept, of)


def is_materials_list(text: Column) -> Column:
    """Whether a string lists compounds of one plural anion ("lead and tin oxides")."""
    plural = "|".join(f"{a}s" for a in ions()["anion"])
    return (F.lower(text).rlike(plural) | text.contains("metal")) & text.rlike("and |,| of ")


def names_of_list(text: Column) -> Column:
    """Names of all compounds of a list: each cation, its valency, the one plural anion and the hydrate; else empty."""
    parts = F.filter(F.split(text, r"[\s,]+"), lambda p: p != "")
    anions = tuple(f"{a}s" for a in (*ions()["anion"], "metal"))
    cations = tuple(ions()["cation"])
    found = F.filter(parts, lambda p: is_in(F.lower(p), anions))
    hydrate = F.regexp_extract(text, r"([a-z]*hydrate)", 1)
    names = literal_map(SYMBOL_TO_NAME)
    rows = F.filter(
        F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.get(parts, i + 1).alias("next"))), lambda r: is_in(F.lower(r["p"]), cations) | is_in(r["p"], ELEMENTS)
    )
    named = F.transform(
        rows,
        lambda r: F.concat_ws(
            " ",
            F.coalesce(F.try_element_at(names, r["p"]), F.lower(r["p"])),
            F.when(r["next"].rlike("^[(][IVX]+[)]$"), r["next"]),
            F.regexp_replace(found[0], "s$", ""),
            F.when((hydrate != "") & ~hydrate.isin("anhydrate", "dehydrate", "nonhydrate"), hydrate),
        ),
    )
    return F.when(F.size(found) == 1, named).otherwise(F.array().cast("array<string>"))


def extract_formula(text: Column) -> Column:
    """struct(formula, name): the one formula among the words of a string, and the others.

    No formula: the string is a name; several: the string is a formula.
    """
    s = F.trim(F.regexp_replace(F.replace(text, F.lit("["), F.lit(" [")), r"\s{2,}", " "))
    parts = F.split(s, r"\s")

    def formula_like(p: Column) -> Column:
        amounts = fm.parse(p)
        real = F.forall(amounts, lambda x: fm.is_element(x["el"])) & ~F.forall(amounts, lambda x: (F.length(x["el"]) == 1) & (x["n"] == 1))
        return F.coalesce(real, F.lit(False)) & ~p.rlike(r"^[(][IV,]+[)]") | is_in(F.btrim(p, F.lit("+-1234567890")), ELEMENTS)

    formulas = F.filter(parts, formula_like)
    terms = F.filter(parts, lambda p: ~formula_like(p))
    none = F.lit(None).cast("string")
    n = F.size(formulas)
    return F.struct(
        F.when(F.size(parts) == 1, none).when(n > 1, s).when(n == 1, formulas[0]).alias("formula"),
        F.when(F.size(parts) == 1, s).when(n > 1, none).when(n == 0, s).otherwise(F.array_join(terms, " ")).alias("name"),
    )


def string2formula(text: Column) -> Column:
    """struct(formula, method): by dictionary, abbreviation, a formula within, reconstruction of the name, or the string itself."""

    def found(formula: Column, method: str) -> Column:
        return fm.let(formula, lambda f: F.when(f.isNotNull(), F.struct(f.alias("formula"), F.lit(method).alias("method"))))

    # those after the first that has one are not tried
    return F.coalesce(
        found(F.try_element_at(literal_map(compounds()), text), "dictionary"), found(F.try_element_at(literal_map(abbreviations()), text), "abbreviation"),
        found(extract_formula(text)["formula"], "formula"), found(formula_from_name(text), "name"), found(F.nullif(text, F.lit("")), "string"),
    )


# additives ----------------------------------------------------------------------------


def separate_additives(name: Column) -> Column:
    """struct(material, additives): "X doped with Y", "Y-doped X", "X - 5 mol% Y" and "X:Y"."""
    none = F.array().cast("array<string>")
    start = F.struct(F.regexp_replace(name, "co-?doped", "doped").alias("s"), none.alias("found"))
    with_, before = rf"^(.*?)[\s+-]*{_ADDED} with (.*)$", rf"^(.*)[-\s]{_ADDED} (.*)$"

    def state(s: Column, found: Column) -> Column:
        return F.struct(s.alias("s"), found.alias("found"))

    def doped_with(x: Column) -> Column:
        s = x["s"]
        return F.when(
            s.rlike(with_), state(F.btrim(F.regexp_extract(s, with_, 1), F.lit(" -+")), F.array(F.trim(F.regexp_extract(s, with_, 2))))
        ).otherwise(x)

    def doped_by(x: Column) -> Column:
        s = x["s"]
        return F.when(s.rlike(before), state(F.regexp_extract(s, before, 2), F.concat(x["found"], F.array(F.regexp_extract(s, before, 1))))).otherwise(x)

    def share(x: Column) -> Column:
        parts = F.split(F.replace(x["s"], F.lit(".%"), F.lit("%")), r"[-+:·]?\s*[0-9x.]*\s*(?:vol|mol|wt|at)?\s*%")
        more = lambda p: F.filter(F.transform(F.slice(p, 2, 1 << 20), lambda q: F.trim(q)), lambda q: q != "")
        return fm.let(parts, lambda p: F.when(F.size(p) > 1, state(F.btrim(p[0], F.lit(" -+")), F.concat(x["found"], more(p)))).otherwise(x))

    def only_elements(p: Column) -> Column:
        own = F.filter(F.split(p, r"[\s,/]"), lambda w: w != "")
        return (F.size(own) > 0) & F.forall(own, lambda w: is_in(F.btrim(w, F.lit("zyx,+0987654321. ")), (*ELEMENTS, "R")))

    def colon(x: Column) -> Column:
        def of(pieces: Column) -> Column:
            rest = F.filter(pieces, lambda p: ~only_elements(p))
            host = F.when(F.size(rest) > 0, F.element_at(rest, -1)).otherwise(x["s"])
            return F.when(F.size(pieces) > 1, state(host, F.concat(x["found"], F.filter(pieces, only_elements)))).otherwise(x)

        return fm.let(F.transform(F.split(x["s"], ":"), lambda p: F.trim(p)), of)

    def done(x: Column) -> Column:
        found = F.flatten(F.transform(x["found"], lambda a: F.split(a, r"[\s,/-]|and")))
        found = F.filter(F.transform(found, lambda a: F.trim(a)), lambda a: a != "")
        return F.struct(F.regexp_replace(x["s"], r"[( ,.:;±/+-]+$", "").alias("material"), found.alias("additives"))

    out = start
    for step in (doped_with, doped_by, share, colon, done):
        out = fm.let(out, step)
    return out


def get_dopants(name: Column) -> Column:
    """struct(material, dopants) where dopants are phrases, not split into their parts."""
    got = separate_additives(name)
    whole = F.regexp_replace(name, "co-?doped", "doped")
    with_ = F.regexp_extract(whole, rf"{_ADDED} with (.*)$", 1)
    before = F.when(with_ == "", F.regexp_extract(whole, rf"^(.*)[-\s]{_ADDED} ", 1)).otherwise(F.lit(""))
    phrase = F.filter(F.array(F.trim(with_), F.trim(before)), lambda p: p != "")
    return F.struct(got["material"].alias("material"), F.when(F.size(phrase) > 0, phrase).otherwise(got["additives"]).alias("dopants"))


def with_additive(amounts: Column, additive: Column) -> Column:
    """A numeric composition with "Nb0.05" or "0.05Nb" put in, if the sum of all amounts then is whole; else as it is."""
    a = F.regexp_replace(additive, "[0-9]*[+]$", "")
    el = F.regexp_extract(a, r"([A-Z][a-z]?)", 1)
    n = F.regexp_replace(F.regexp_extract(a, r"([0-9]+[.]?[0-9]*)", 1), "^0([1-9])", "0.$1").try_cast("double")
    total = F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x["n"]) + n
    fits = F.coalesce((F.abs(total - F.rint(total)) < 5e-4) & fm.is_element(el) & ~F.exists(amounts, lambda x: x["el"] == el), F.lit(False))
    return F.when(fits, F.array_sort(F.concat(amounts, F.array(F.struct(el.alias("el"), n.alias("n")))))).otherwise(amounts)


# abbreviations --------------------------------------------------------------------------


def is_abbreviation(word: Column) -> Column:
    """Only capitals (numbers, x, dashes, dots and parentheses aside), at least two of them other than O."""
    bare = F.regexp_replace(word, r"[0-9x().-]", "")
    return bare.rlike(r"^\p{Lu}*$") & (F.size(F.regexp_extract_all(word, F.lit("[A-NP-Z]"), F.lit(0))) > 1)


def capital_signature(word: Column) -> Column:
    """The capitals of a word but O, sorted: equal for an abbreviation and what it stands for."""
    return F.array_join(F.array_sort(F.regexp_extract_all(word, F.lit("[A-NP-Z]"), F.lit(0))), "")


def is_acronym(formula: Column, amounts: Column) -> Column:
    """Whether a parsed formula reads as an acronym: capitals alone with amounts of 1, or three capitals in a row outside CH, COO and OH."""
    ones = F.forall(amounts, lambda x: (F.length(x["el"]) == 1) & (x["n"] == 1))
    odd = formula.rlike("^[A-Z]+$") & F.exists(F.split(formula, ""), lambda c: ~is_in(c, ELEMENTS) & (c != ""))
    run = formula.rlike("[A-Z]{3,}") & ~formula.rlike("CH|COO|OH")
    return F.coalesce(ones, F.lit(False)) | odd | run | formula.startswith("PV")


# variables ------------------------------------------------------------------------------


def _extract(text: Column, pattern: Column, group: int) -> Column:
    return F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(group)), F.lit(""))


def _value(token: Column) -> Column:
    t = F.rtrim(F.trim(token), F.lit("., "))
    ratio = F.split(t, "/")
    return F.when(t.contains("/"), F.try_divide(ratio[0].try_cast("double"), ratio[1].try_cast("double"))).otherwise(t.try_cast("double"))


def stoichiometric_values(variable: Column, sentence: Column, count: int = 10) -> Column:
    """struct(values, min, max, mode) of a variable: "x = 1, 2", "x = 1-2", "1 < x < 2", "x from 1 to 2", the first that matches.

    A range has ``count`` equal steps and its upper end.
    """
    s = F.replace(sentence, F.lit(" - "), F.lit("-"))
    listed = _extract(s, F.concat(variable, F.lit(r"\s*=\s*(-?[0-9.,/\s]+(?:and[0-9.,/\s]+)?)(?:[\s)\],;]|$)")), 1)
    values = F.filter(
        F.transform(F.split(listed, r"[,\s]+|and"), lambda v: F.round(_value(v), 4)), lambda v: v.isNotNull()
    )
    ranges = [
        (F.concat(variable, F.lit(r"\s*=\s*([0-9.]+)\s*[–-]\s*([0-9.]+)"))),
        (F.concat(F.lit(r"([0-9.]+)\s*[<≤⩽]\s*"), variable, F.lit(r"\s*[<≤⩽]\s*([0-9.]+)"))),
        (F.concat(variable, F.lit(r"[a-z\s]*from\s+([0-9./]+)\s+to\s+([0-9./]+)"))),
    ]
    low = F.coalesce(*[_value(_extract(s, r, 1)) for r in ranges])
    high = F.coalesce(*[_value(_extract(s, r, 2)) for r in ranges])

    def of(x: Column) -> Column:
        steps = F.concat(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(x["low"] + i * (x["high"] - x["low"]) / count, 4)), F.array(F.round(x["high"], 4)))
        is_range = x["low"].isNotNull() & x["high"].isNotNull() & ((F.size(x["values"]) <= 0) | x["values"].isNull() | x["ranged"])
        is_list = ~is_range & (F.size(x["values"]) > 0)
        mode = F.when(is_range, F.lit("range")).when(is_list, F.lit("values"))

        def made(m: Column) -> Column:
            got = F.when(m == "range", steps).when(m == "values", x["values"]).otherwise(F.array().cast("array<double>"))
            return fm.let(got, lambda g: F.struct(g.alias("values"), F.array_min(g).alias("min"), F.array_max(g).alias("max"), m.alias("mode")))

        return fm.let(mode, made)

    # what patterns find is computed once, not at every step of a range
    return fm.let(F.struct(values.alias("values"), low.alias("low"), high.alias("high"), s.rlike(r"=\s*[0-9.]+\s*[–-]\s*[0-9.]").alias("ranged")), of)


def element_values(variable: Column, sentence: Column) -> Column:
    """Elements listed after a variable and = or :, charges left out, each once, in order."""
    listed = _extract(sentence, F.concat(variable, F.lit(r"\s*[=:]\s*([A-Za-z0-9+,\s]+)")), 1)
    parts = F.transform(F.split(listed, r"[,\s]+"), lambda p: F.rtrim(p, F.lit("0987654321+")))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda p: is_in(p, ELEMENTS))), F.array().cast("array<string>"))


def combine_formula(parts: Column) -> Column:
    """One formula of array<struct(formula, amount)>, sorted by formula; hydrates follow a dot, other parts a dash."""
    ordered = F.array_sort(parts)

    def shown(r: Column) -> Column:
        amount = F.when(r["amount"].rlike("^[0-9.]+$"), fm.cast_stoichiometry(r["amount"].try_cast("double"))).when(r["amount"] == "x", F.lit("x")).otherwise(F.concat(F.lit("("), r["amount"], F.lit(")")))
        return F.concat(F.when(r["formula"].contains("H2O"), F.lit("·")).otherwise(F.lit("-")), amount, r["formula"])

    many = F.regexp_replace(F.array_join(F.transform(ordered, shown), ""), "^[-]|[*]", "")
    return F.when(F.size(parts) == 1, F.replace(parts[0]["formula"], F.lit("*"), F.lit(""))).otherwise(many)


def element_of_name(name: Column) -> Column:
    return F.try_element_at(literal_map(NAME_TO_SYMBOL), F.lower(name))


def known_elements() -> Column:
    return literal_array(ELEMENTS)
