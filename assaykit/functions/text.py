"""Tokenisation and token normalisation as column functions.

All of them are built from higher-order functions and regular expressions, so they run in
the JVM on batches and streams alike.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions import formula as fm
from assaykit.functions.lexicon import ELEMENTS, NAME_TO_SYMBOL, NUMBER_TOKEN, PUNCTUATION, UNITS, emoji, is_in, literal_map

#: Words of letters and digits with inner decimals and parentheses (formulas, valences), or one sign.
TOKEN = r"[\p{L}0-9]+(?:[.,][0-9]+|[(][\p{L}0-9.]*[)]|[\p{L}0-9])*|[^\s]"
_NUMBER = r"^[-+]?[0-9]*[.]?[0-9]+[(]?[0-9]*[)]?$"
_NUMBER_UNIT = r"^([-+]?[0-9]*[.]?[0-9]+[(]?[0-9]*[)]?)([\p{IsLatin}Ωμ|].*)$"
_NAMES = "|".join(sorted([*ELEMENTS, *NAME_TO_SYMBOL, *(n.capitalize() for n in NAME_TO_SYMBOL)], key=lambda x: (-len(x), x)))
_VALENCE = rf"^({_NAMES})([(](?:I|II|III|IV|V|VI|VII|VIII|i|ii|iii|iv|v|vi|vii|viii)[)])$"
_DIRECTION = rf"^(?:{_NAMES})[(][0-9]{{3,4}}[)]"


def sentences(text: Column) -> Column:
    """Sentences: a text is cut at line ends and after . ! or ? before white space; blank ones go."""
    cut = F.regexp_replace(text, r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(cut, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def words(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))


def split_token(token: Column, split_oxidation: bool = True) -> Column:
    """"5V" to 5 and V if V is a unit; "Fe(II)" to Fe and (II); else the token alone."""
    unit = F.regexp_extract(token, _NUMBER_UNIT, 2)
    # long patterns are tried only where they can fit: after a digit, sign or point, and with a parenthesis
    out = F.when((F.ascii(token) <= ord("9")) & is_in(unit, UNITS), F.array(F.regexp_extract(token, _NUMBER_UNIT, 1), unit))
    if split_oxidation:
        out = out.when(token.contains("(") & token.rlike(_VALENCE), F.array(F.regexp_extract(token, _VALENCE, 1), F.regexp_extract(token, _VALENCE, 2)))
    return out.otherwise(F.array(token))


def tokenize(text: Column, split_oxidation: bool = True, keep_sentences: bool = True, split: bool = True) -> Column:
    """Tokens of each sentence, or of the text.  ``split=False`` leaves units and valences where they are."""

    def of(s: Column) -> Column:
        ws = words(s)
        return F.flatten(F.transform(ws, lambda t: split_token(t, split_oxidation))) if split else ws

    out = F.transform(sentences(text), of)
    return out if keep_sentences else F.flatten(out)


def is_number(token: Column) -> Column:
    return F.regexp_replace(token, ",", "").rlike(_NUMBER)


def is_punctuation(token: Column) -> Column:
    return is_in(token, PUNCTUATION)


def _accents() -> tuple[str, str]:
    plain = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1]
    plain = [(a, b) for a, b in plain if b.isascii()]
    return "".join(a for a, _ in plain), "".join(b for _, b in plain)


_ACCENTED, _PLAIN = _accents()
_LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"}


def strip_accents(text: Column) -> Column:
    """Latin letters without their diacritics."""
    return F.translate(text, _ACCENTED, _PLAIN)


def remove_accent(token: Column) -> Column:
    """As ``strip_accents``, ligatures resolved; tokens of one character stay."""
    out = strip_accents(token)
    for a, b in _LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when((F.length(token) > 1) & (F.octet_length(token) > F.length(token)), out).otherwise(token)


def _is_lowered(token: Column) -> Column:
    title = token.rlike(r"^\p{Lu}[^\p{Lu}]*$") & (F.lower(F.substring(token, 2, 1 << 20)) == F.substring(token, 2, 1 << 20)) & token.rlike(r"^.\P{L}*\p{Ll}")
    return ((F.length(token) == 1) | title) & ~is_in(token, ELEMENTS) & ~is_in(token, UNITS) & ~(token.contains("(") & token.rlike(_DIRECTION))


def selective_lower(token: Column) -> Column:
    """Single characters and capitalised words in lower case, but for element symbols, units and Si(111)."""
    return F.when(_is_lowered(token), F.lower(token)).otherwise(token)


def _is_name(token: Column) -> Column:
    lowered = F.lower(token)
    return is_in(lowered, tuple(NAME_TO_SYMBOL)) & ((token == lowered) | (token == F.initcap(lowered)))


def process(
    tokens: Column, exclude_punct: bool = False, convert_num: bool = True, normalize_materials: bool = True, remove_accents: bool = True
) -> Column:
    """struct(tokens, materials array<struct(surface, formula)>) of a token array.

    Per token the first of these applies: punctuation goes (if excluded); a number becomes
    ``<nUm>`` unless it stands alone in ( ) or 〈 〉, its neighbours being those of the given
    tokens and none beyond their ends; an element's name is lower-cased and a material; a
    simple formula is a material and put in its normal form; else selective lower case.
    """
    return fm.let(_rows(tokens, exclude_punct, convert_num, normalize_materials, remove_accents), _processed)


def processed_tokens(tokens: Column, exclude_punct: bool = False, convert_num: bool = True, normalize_materials: bool = True, remove_accents: bool = True) -> Column:
    """The tokens of ``process`` alone."""
    return F.transform(_rows(tokens, exclude_punct, convert_num, normalize_materials, remove_accents), lambda r: r["token"])


def processed_pairs(tokens: Column) -> Column:
    """array<struct(tok, raw)>: the tokens of ``process`` with and without numbers converted, in one pass; a number is its own raw form."""
    return F.transform(_rows(tokens, False, True, True, True), lambda r: F.struct(r["token"].alias("tok"), F.when(r["number"], r["surface"]).otherwise(r["token"]).alias("raw")))


#: Words of Latin letters, small but for the first, that ``process`` may treat as more than words.
_MARKED = tuple(sorted({*NAME_TO_SYMBOL, *(n.capitalize() for n in NAME_TO_SYMBOL), *ELEMENTS, *UNITS}))


def _rows(tokens: Column, exclude_punct: bool, convert_num: bool, normalize_materials: bool, remove_accents: bool) -> Column:
    """array<struct(token, surface, formula, punct, number)>, a row for each token that is kept."""
    symbols = literal_map(NAME_TO_SYMBOL)
    none, no, yes = F.lit(None).cast("string"), F.lit(False), F.lit(True)

    def row(token: Column, surface: Column, formula: Column, punct: Column, number: Column) -> Column:
        return F.struct(token.alias("token"), surface.alias("surface"), formula.alias("formula"), punct.alias("punct"), number.alias("number"))

    def of(own: Column) -> Column:
        def step(t: Column, i: Column) -> Column:
            def known(k: Column) -> Column:
                def made(formula: Column) -> Column:
                    before, after = F.get(own, i - 1), F.get(own, i + 1)
                    direction = F.coalesce(((before == "(") & (after == ")")) | ((before == "〈") & (after == "〉")), no)
                    shown = (
                        F.when(k == 1, F.when(direction, t).otherwise(F.lit(NUMBER_TOKEN)))
                        .when(k == 2, F.lower(t))
                        .when(k == 3, formula if normalize_materials else t)
                        .otherwise(selective_lower(t))
                    )
                    shown = fm.let(shown, remove_accent) if remove_accents else shown
                    found = F.when(k == 2, symbols[F.lower(t)]).when(k == 3, formula).otherwise(none)
                    return row(shown, t, found, no, k == 1)

                return fm.let(F.when(k == 3, fm.normalized_formula(t)), made)

            number = is_number(t) if convert_num else no
            kind = F.when(number, F.lit(1)).when(_is_name(t), F.lit(2)).when(fm.is_simple_formula(t), F.lit(3)).otherwise(F.lit(4))
            # most tokens are plain words or signs, which no rule but lower case changes
            plain = t.rlike("^[A-Za-z][a-z]*$") & ~is_in(t, _MARKED)
            return F.when(plain, row(F.lower(t), t, none, no, no)).when(is_punctuation(t), row(t, t, none, yes, no)).otherwise(fm.let(kind, known))

        return F.transform(own, step)

    rows = fm.let(tokens, of)
    return F.filter(rows, lambda r: ~r["punct"]) if exclude_punct else rows


def _processed(rows: Column) -> Column:
    return F.struct(
        F.transform(rows, lambda r: r["token"]).alias("tokens"),
        F.transform(F.filter(rows, lambda r: r["formula"].isNotNull()), lambda r: F.struct(r["surface"].alias("surface"), r["formula"].alias("formula"))).alias("materials"),
    )


def split_sentence(tokens: Column) -> Column:
    """struct(tokens, split_at): units and valences split, and the places of the tokens that were."""
    parts = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), split_token(t).alias("own")))
    return F.struct(
        F.flatten(F.transform(parts, lambda r: r["own"])).alias("tokens"), F.transform(F.filter(parts, lambda r: F.size(r["own"]) > 1), lambda r: r["at"]).alias("split_at")
    )


def with_raw_numbers(tokens: Column, tags: Column) -> Column:
    """(token, tag) pairs that show the numbers a tagger saw as ``<nUm>``: raw tokens zipped with tags."""
    return F.zip_with(tokens, tags, lambda t, g: F.struct(t.alias("token"), g.alias("tag")))


def subscripts(text: Column, latex: bool = False) -> Column:
    """Numbers of a formula as <sub>n</sub>, or _n."""
    return F.regexp_replace(text, r"([0-9]*[.]?[0-9]+)", "_$1" if latex else "<sub>$1</sub>")


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return F.aggregate(rows, text, lambda s, r: F.replace(s, r["a"], r["b"]))


def emojify(formula: Column) -> Column:
    return _replaced(formula, sorted(emoji().items(), key=lambda x: (-len(x[0]), x[0])))


def unemojify(formula: Column) -> Column:
    return _replaced(formula, [(b, a) for a, b in sorted(emoji().items(), key=lambda x: (-len(x[1]), x[1]))])


def merge_phrases(tokens: Column, phrases: Column, reps: int = 2) -> Column:
    """Adjacent tokens joined by _ where the pair is in ``phrases`` (array of a_b), greedily from the left, ``reps`` times."""

    none = F.array().cast("array<int>")

    def joined_at(own: Column) -> Column:
        """Places whose token is joined to the next: of each run of pairs the first, third, ..."""
        pair = lambda i: F.array_contains(phrases, F.concat_ws("_", F.get(own, i), F.get(own, i + 1)))
        pairs = F.when(F.size(own) > 1, F.filter(F.sequence(F.lit(0), F.size(own) - 2), pair)).otherwise(none)

        def every_second(at: Column) -> Column:
            def runs(first: Column) -> Column:
                last = lambda j: F.get(at, F.coalesce(F.get(first, j + 1), F.size(at)) - 1)
                return F.flatten(F.transform(first, lambda f, j: F.sequence(F.get(at, f), last(j), F.lit(2))))

            starts = F.filter(F.transform(at, lambda x, j: F.when((j == 0) | (F.get(at, j - 1) != x - 1), j)), lambda j: j.isNotNull())
            return fm.let(starts, runs)

        return fm.let(pairs, every_second)

    def once(ts: Column) -> Column:
        def of(own: Column) -> Column:
            def put(at: Column) -> Column:
                def piece(m: Column, j: Column) -> Column:
                    begin = F.coalesce(F.get(at, j - 1) + 2, F.lit(0))
                    return F.concat(F.slice(own, begin + 1, m - begin), F.array(F.concat_ws("_", F.get(own, m), F.get(own, m + 1))))

                done = F.get(at, F.size(at) - 1) + 2
                return F.when(F.size(at) == 0, own).otherwise(F.concat(F.flatten(F.transform(at, piece)), F.slice(own, done + 1, F.size(own) - done)))

            return fm.let(joined_at(own), put)

        return fm.let(ts, of)

    for _ in range(reps):
        tokens = once(tokens)
    return tokens


def pad(a: Column, length: Column, value: Column) -> Column:
    """An array cut or filled with ``value`` to ``length``."""
    return F.concat(F.slice(a, F.lit(1), length), F.array_repeat(value, F.greatest(length - F.size(a), F.lit(0))))


def number_word(word: Column, lowercase: bool = True) -> Column:
    """The vocabulary's key of a word: lower case, and $NUM$ for digits alone."""
    w = F.lower(word) if lowercase else word
    return F.when(w.rlike("^[0-9]+$"), F.lit("$NUM$")).otherwise(w)
