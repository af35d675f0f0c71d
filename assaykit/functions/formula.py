"""Chemical formulas with numeric amounts, as folds over token arrays.

A formula is read from its end with a stack of multipliers: ``)n`` pushes, ``(`` pops, an
element emits its amount times the top.  Nothing here is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions.lexicon import DIATOMIC, ELEMENTS, GREEK, is_in

_ITEM = r"([A-Z][a-z]?|[()])([0-9]*[.]?[0-9]*)"
_AMOUNTS = "array<struct<el:string,n:double>>"
_VALENCE = r"II+|^IV$|^VI$|[(]IV[)]|[(]V?I{0,3}[)]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, so that expressions don't multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_element(symbol: Column) -> Column:
    return is_in(symbol, ELEMENTS)


def parse(formula: Column) -> Column:
    """Amounts array<struct(el, n)>, one per symbol in alphabetical order; null if it is no formula.

    Symbols are not checked to be elements; signs other than symbols, numbers and balanced
    parentheses make it null, as does a formula of no symbols.
    """
    items = F.regexp_extract_all(formula, F.lit(_ITEM), F.lit(0))
    whole = F.array_join(items, "") == formula
    start = F.struct(F.array(F.lit(1.0)).alias("stack"), F.array().cast(_AMOUNTS).alias("out"), F.lit(True).alias("ok"))

    def step(s: Column, item: Column) -> Column:
        head = F.regexp_extract(item, "^([A-Z][a-z]?|[()])", 1)
        digits = F.regexp_extract(item, "([0-9]*[.]?[0-9]*)$", 1)
        n = F.when(digits == "", F.lit(1.0)).otherwise(digits.try_cast("double"))
        top = F.element_at(s["stack"], -1)
        depth = F.size(s["stack"])
        pushed = F.concat(s["stack"], F.array(top * n))
        popped = F.slice(s["stack"], F.lit(1), F.greatest(depth - 1, F.lit(1)))
        stack = F.when(head == ")", pushed).when(head == "(", popped).otherwise(s["stack"])
        out = F.when(head.isin("(", ")"), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(head.alias("el"), (top * n).alias("n")))))
        fine = n.isNotNull() & ((head != "(") | ((depth > 1) & (digits == "")))
        return F.struct(stack.alias("stack"), out.alias("out"), (s["ok"] & fine).alias("ok"))

    def total(s: Column) -> Column:
        symbols = F.array_sort(F.array_distinct(F.transform(s["out"], lambda x: x["el"])))
        sums = F.transform(
            symbols,
            lambda e: F.struct(
                e.alias("el"), F.aggregate(F.filter(s["out"], lambda x: x["el"] == e), F.lit(0.0), lambda acc, x: acc + x["n"]).alias("n")
            ),
        )
        return F.when(s["ok"] & (F.size(s["stack"]) == 1) & (F.size(symbols) > 0), sums)

    return F.when(whole, F.aggregate(F.reverse(items), start, step, total))


def _gcd(a: Column, b: Column, tolerance: float) -> Column:
    """Euclid's algorithm on doubles, to a tolerance, in a bounded number of steps."""
    start = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        start,
        lambda s, _: F.when(s["b"] > tolerance, F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))).otherwise(s),
        lambda s: s["a"],
    )


def gcd(amounts: Column, tolerance: float = 1e-3) -> Column:
    """Tolerant greatest common divisor of an array of doubles, zeros aside."""
    return F.aggregate(F.filter(amounts, lambda x: x > 0), F.lit(0.0), lambda acc, x: F.when(acc == 0, x).otherwise(_gcd(acc, x, tolerance)))


def integer_formula(amounts: Column, max_denominator: int = 1000) -> Column:
    """Amounts as the smallest whole numbers, symbols in alphabetical order, ones not written and zeros left out."""

    def shown(x: Column, g: Column) -> Column:
        n = F.rint(x["n"] / g).cast("long")
        return F.when(n == 0, F.lit("")).otherwise(F.concat(x["el"], F.when(n > 1, n.cast("string")).otherwise(F.lit(""))))

    def of(own: Column) -> Column:
        g = gcd(F.transform(own, lambda x: x["n"]), 1.0 / max_denominator)
        return let(g, lambda k: F.when(k > 0, F.array_join(F.transform(F.array_sort(own), lambda x: shown(x, k)), "")))

    return let(amounts, of)


def _of_elements(amounts: Column) -> Column:
    return F.coalesce(F.forall(amounts, lambda x: is_element(x["el"])), F.lit(False))


def normalized_formula(text: Column, max_denominator: int = 1000) -> Column:
    """The integer formula, or the text if it is none or has symbols that are no elements."""
    return F.coalesce(let(parse(text), lambda a: F.when(_of_elements(a), integer_formula(a, max_denominator))), text)


def is_simple_formula(text: Column) -> Column:
    """Whether a token reads as a compound: no valence sign, a digit or small letter, at least two elements or a diatomic one."""
    compound = let(parse(text), lambda a: F.coalesce(F.size(a) > 1, F.lit(False)) & _of_elements(a))
    diatomic = is_in(text, tuple(f"{e}2" for e in DIATOMIC))
    # most tokens of a text end here: no second capital or digit after a first capital
    hopeless = ~text.rlike(r"[A-Z].*[A-Z0-9]") | ~text.rlike(r"[0-9\p{Ll}]") | text.rlike(_VALENCE)
    return F.when(hopeless, F.lit(False)).otherwise(diatomic | compound)


def alphabetize(formula: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(formula, F.lit(r"[A-Z][a-z]?[0-9]*"), F.lit(0))), "")


def reduced_formula(formula: Column) -> Column:
    """Canonical form by reduction: whole amounts without a common divisor, diatomic elements as X2; null if it is no formula of elements."""
    whole = let(parse(formula), lambda a: F.when(_of_elements(a), integer_formula(a)))
    return let(whole, lambda w: F.when(is_in(w, DIATOMIC), F.concat(w, F.lit("2"))).otherwise(w))


def first_parsed(text: Column, *parsers) -> Column:
    """The result of the first parser (a column function) that has one; ``reduced_formula`` if none is given."""
    return F.coalesce(*[p(text) for p in parsers or (reduced_formula,)])


def unify_brackets(formula: Column) -> Column:
    return F.translate(formula, "[]{}", "()()")


def parentheses_balanced(formula: Column) -> Column:
    """Whether every parenthesis is closed after it is opened."""
    signs = F.regexp_extract_all(formula, F.lit("[()]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (s["ok"] & (depth >= 0)).alias("ok"))

    return F.aggregate(signs, start, step, lambda s: s["ok"] & (s["depth"] == 0))


def _unmatched(formula: Column) -> Column:
    """struct(close, open): numbers of ) without a ( before, and of ( without a ) after."""
    signs = F.regexp_extract_all(formula, F.lit("[()]"), F.lit(0))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("close"))

    def step(s: Column, c: Column) -> Column:
        up = c == "("
        lost = ~up & (s["open"] == 0)
        return F.struct(
            F.when(up, s["open"] + 1).otherwise(F.greatest(s["open"] - 1, F.lit(0))).alias("open"), (s["close"] + F.when(lost, 1).otherwise(0)).alias("close")
        )

    return F.aggregate(signs, start, step)


def check_parentheses(formula: Column) -> Column:
    """Brackets unified, a useless outer or lone parenthesis dropped, then missing ones added at the ends."""

    def cut(pattern: str, first: int, dropped: int) -> Callable[[Column], Column]:
        def of(f: Column) -> Column:
            inner = f.substr(F.lit(first), F.greatest(F.length(f) - dropped, F.lit(0)))
            return let(inner, lambda i: F.when(f.rlike(pattern) & parentheses_balanced(i), i).otherwise(f))

        return of

    def repaired(f: Column) -> Column:
        return let(_unmatched(f), lambda u: F.concat(F.repeat(F.lit("("), u["close"]), f, F.repeat(F.lit(")"), u["open"])))

    f = unify_brackets(formula)
    for pattern, first, dropped in (("^[(].*[)]$", 2, 2), ("^[(]", 2, 1), ("[)]$", 1, 1)):
        f = let(f, cut(pattern, first, dropped))
    return let(f, repaired)


def combine_parts(text: Column) -> Column:
    """Blanks that break a formula taken out: pieces are joined until their parentheses balance."""
    parts = F.split(text, r"\s")
    start = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        now = F.concat(F.coalesce(s["held"], F.lit("")), p)
        done = parentheses_balanced(now)
        return F.struct(F.when(done, F.lit(None).cast("string")).otherwise(now).alias("held"), F.when(done, F.concat(s["out"], F.array(now))).otherwise(s["out"]).alias("out"))

    return F.trim(
        F.aggregate(parts, start, step, lambda s: F.array_join(F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))), " "))
    )


def oxygen_deficiency(formula: Column) -> Column:
    """struct(formula, sign, symbol): a deficiency such as O3-δ at the end, taken off."""
    pattern = rf"(O[0-9]*)([-+±∓])([a-z{GREEK}][0-9]*)([)]*)$"
    sign, symbol = F.regexp_extract(formula, pattern, 2), F.regexp_extract(formula, pattern, 3)
    return F.struct(F.regexp_replace(formula, pattern, "$1$4").alias("formula"), F.nullif(sign, F.lit("")).alias("sign"), F.nullif(symbol, F.lit("")).alias("symbol"))


def elements_occur(amounts: Column, formula: Column) -> Column:
    """Whether a parsed composition is not empty and all its symbols stand in the formula."""
    return (F.size(amounts) > 0) & F.forall(amounts, lambda x: F.instr(F.concat(formula, F.lit("MLn")), x["el"]) > 0)


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple of two positive integers."""
    g = F.aggregate(
        F.sequence(F.lit(1), F.lit(48)),
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda s, _: F.when(s["b"] != 0, F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))).otherwise(s),
        lambda s: s["a"],
    )
    return F.floor(a.cast("long") * b.cast("long") / g).cast("long")


def cast_stoichiometry(value: Column) -> Column:
    """How an amount is written: nothing for 1, an integer without decimals."""
    v = value.cast("double")
    return F.when(v == 1, F.lit("")).when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def is_int(value: Column) -> Column:
    v = value.try_cast("double")
    return F.coalesce(F.round(v, 3) == F.rint(v), F.lit(False))
