"""Column functions over words and texts, all of them built from Spark's own expressions but for `nfc`.

Words are cut at white space; classes are spelt out, since the short forms of the pattern languages differ.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import vocabulary

SPACE = "[ \\t\\n\\r\\f]+"
TRIPLES = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyzäöüßàâçéèêëîïôùû")


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark lacks; only needed for words with combining marks."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


_MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0323\u0327\u0328"
#: Small letters of Latin and Greek with one mark, as the two characters and as the one that is the same.
_COMPOSED = {b + m: c for b in map(chr, [*range(97, 123), 230, 248, *range(945, 970)]) for m in _MARKS if len(c := unicodedata.normalize("NFC", b + m)) == 1}


def composed(word: Column) -> Column:
    """A word in small letters with letters and their marks as one character, where there is one. Without marks it costs a look."""
    table = F.create_map(*[F.lit(x) for pair in _COMPOSED.items() for x in pair])
    letters = F.transform(F.regexp_extract_all(word, F.lit("\\P{M}?\\p{M}*"), F.lit(0)), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.when(F.regexp_like(word, F.lit("\\p{M}")), F.array_join(letters, "")).otherwise(word)


def clean_word(word: Column) -> Column:
    """Letters, numbers, underscores and inner apostrophes, in lower case; a letter and its mark are one character."""
    return F.btrim(F.regexp_replace(composed(F.lower(word)), "[^\\p{L}\\p{N}_']", ""), F.lit("'"))


def bare_word(word: Column) -> Column:
    """clean_word without any apostrophe."""
    return F.regexp_replace(F.lower(word), "[^\\p{L}\\p{N}_]", "")


#: Letters whose capital is spelt with several characters, and the one character that stands for it: a capital sharp s, a title's letter or the letter itself.
_CAPITALS = {c: t if len(t := c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def upper(word: Column) -> Column:
    """Capital letters, one for each letter, as SQL's upper has them."""
    table = F.create_map(*[F.lit(x) for pair in _CAPITALS.items() for x in pair])
    letters = F.transform(F.split(word, ""), lambda x: F.coalesce(F.try_element_at(table, x), F.upper(x)))
    return F.when(F.regexp_like(word, F.lit(f"[{''.join(_CAPITALS)}]")), F.array_join(letters, "")).otherwise(F.upper(word))


def pattern_score(word: Column) -> Column:
    """How much a word's form is like a word: 0.7, 0.2 without a vowel, 0 with odd characters, lengths or triple letters."""
    return (
        F.when(~F.regexp_like(word, F.lit("^[a-zA-ZäöüÄÖÜßàâçéèêëîïôùû]+$")), 0.0)
        .when((F.length(word) < 2) | (F.length(word) > 30), 0.0)
        .when(F.regexp_like(F.lower(word), F.lit(TRIPLES)), 0.0)
        .when(~F.regexp_like(F.lower(word), F.lit("[aeiouäöü]")), 0.2)
        .otherwise(0.7)
    )


def is_capitalized(word: Column) -> Column:
    return F.regexp_like(word, F.lit("^\\p{Lu}[^\\p{Lu}]*$"))


def is_all_caps(word: Column) -> Column:
    return F.regexp_like(word, F.lit("\\p{Lu}")) & ~F.regexp_like(word, F.lit("\\p{Ll}")) & (F.length(word) > 1)


def is_foreign(word: Column) -> Column:
    ends = F.regexp_like(word, F.lit(f"({'|'.join(vocabulary.FOREIGN_ENDINGS)})$"))
    return ends | ((F.length(word) >= 6) & F.contains(word, F.lit(vocabulary.FOREIGN_INNER)))


# -- marks of scanning


_LOW = "[a-z]+"
#: Capitals within a word.
CAPS = f"{_LOW}[A-Z]+{_LOW}"
MARKS = {
    "mid_word_caps": "(^|[^\\p{L}\\p{N}_])" + CAPS,
    "digits_in_words": "(^|[^\\p{L}\\p{N}_])[a-zA-Z]+[0-9]+[a-zA-Z]+",
    "broken_hyphenation": "[\\p{L}\\p{N}_]+-[ \\t\\n\\r\\f]+[\\p{L}\\p{N}_]+",
    "double_punctuation": "[.,;:]{2,}",
    "bar_in_word": "[\\p{L}\\p{N}_]\\|[\\p{L}\\p{N}_]",
}


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


#: The same matches as the mark's, but words without a hyphen behind them are passed over once, not from each of their letters.
_QUICK = {"broken_hyphenation": "(?<![\\p{L}\\p{N}_])[\\p{L}\\p{N}_]++-[ \\t\\n\\r\\f]++[\\p{L}\\p{N}_]++"}


def mark_counts(text: Column) -> dict[str, Column]:
    return {name: count(text, _QUICK.get(name, pattern)) for name, pattern in MARKS.items()}


def whole(pattern: str) -> str:
    """The pattern as a whole word."""
    return f"(?<![\\p{{L}}\\p{{N}}_])(?:{pattern})(?![\\p{{L}}\\p{{N}}_])"


#: Characters of other scripts than Latin and Greek, control characters, raised numbers before letters, long runs of capitals, of strokes and of circles.
GARBAGE = ("[^\\x{0}-\\x{7f}\\x{c0}-\\x{24f}\\x{370}-\\x{3ff}\\x{1f00}-\\x{1fff}]", "[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}]", "[⁰¹²³⁴⁵⁶⁷⁸⁹]+[a-z]+", whole("[A-Z]{10,}"), "[|!1l]{5,}", "[oO0]{5,}")


#: Characters without which no text has garbage of the first and third kind, Greek, or raised numbers.
ODD = "[^\\x{0}-\\x{7f}\\x{c0}-\\x{24f}]"


def garbage(text: Column, odd: Column) -> Column:
    """Number of matches of the patterns of garbage; odd says whether the text has any of the characters of ODD."""
    total = F.lit(0).cast("long")
    for k, p in enumerate(GARBAGE):
        total = total + (F.when(odd, count(text, p)).otherwise(0) if k in (0, 2) else count(text, p))
    return total


_VOWEL, _CONSONANT = "[aeiou]", "[b-df-hj-np-tv-z]"
#: Words of three letters or more; those of one kind of letter; those of both kinds with a letter four times in a row.
_WORD, _ONE_KIND = whole("[a-z]{3,}+"), whole(f"{_VOWEL}{{3,}}+|{_CONSONANT}{{3,}}+")
_RUN = f"(?<![\\p{{L}}\\p{{N}}_])(?=[a-z]{{3,}}+(?![\\p{{L}}\\p{{N}}_]))(?=[a-z]*{_VOWEL})(?=[a-z]*{_CONSONANT})[a-z]*?([a-z])\\1{{3}}[a-z]*+"


def word_counts(low: Column) -> tuple[Column, Column]:
    """Numbers of words of three letters or more of a text in small letters, and of those that don't look like words:
    without a vowel or a consonant, or with a letter four times in a row. Common words all look like words."""
    runs = F.when(F.regexp_like(low, F.lit("([a-z])\\1{3}")), count(low, _RUN)).otherwise(0)
    return count(low, _WORD), count(low, _ONE_KIND) + runs


# -- cleaning for embeddings


def remove_page_numbers(text: Column) -> Column:
    """Arabic or roman numbers at the start of a text."""
    return F.regexp_replace(F.regexp_replace(text, "^[0-9]+[ \\t\\n\\r\\f]+", ""), "^[ivxlcIVXLC]+[ \\t\\n\\r\\f]+", "")


def remove_running_heads(text: Column) -> Column:
    return F.regexp_replace(text, "^(CHAPTER|INTRODUCTION|PREFACE|INDEX|NOTES|BIBLIOGRAPHY)[ \\t\\n\\r\\f]+", "")


def remove_note_marks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[¹²³⁰-⁹*†‡]", ""), "([,.;:])[a-z] ", "$1 ")


def for_embedding(text: Column) -> Column:
    cleaned = remove_note_marks(remove_running_heads(remove_page_numbers(text)))
    return F.trim(F.regexp_replace(cleaned, SPACE, " "))


def is_roman(word: Column) -> Column:
    """A numeral from 1 to 999 in canonical form; an l that stands for i is let pass."""
    w = F.lower(word)
    numeral = F.lit("^(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
    return (w != "") & (F.regexp_like(w, numeral) | F.regexp_like(F.replace(w, F.lit("l"), F.lit("i")), numeral))


def basic_correction(text: Column) -> Column:
    """Literal replacements of often confused letters and words, in order. They hit right words too."""
    for a, b in vocabulary.CONFUSED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# -- distances


def aligned_error_rate(a: Column, b: Column) -> Column:
    """Characters that differ place by place, and the difference of lengths, by the length of the first."""
    cut = lambda x: F.split(x, "")
    shared = F.least(F.length(a), F.length(b))
    differ = F.size(F.filter(F.zip_with(F.slice(cut(a), F.lit(1), shared), F.slice(cut(b), F.lit(1), shared), lambda x, y: x != y), lambda x: x))
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.round((differ + F.abs(F.length(a) - F.length(b))) / F.length(a), 6))


def character_error_rate(truth: Column, other: Column) -> Column:
    """Edit distance by the length of the truth, in lower case."""
    n = F.length(truth)
    return F.when(n == 0, F.when(F.length(other) == 0, 0.0).otherwise(1.0)).otherwise(F.round(F.levenshtein(F.lower(truth), F.lower(other)) / n, 6))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


# -- language


STOP = {
    "de": "der die das und ist nicht ein eine zu den von mit auf für des dem sich im".split(),
    "en": "the and of to in is that it was for with as on be by this are from".split(),
    "es": "el la los las de y que en un una por con para del se no es su".split(),
    "fr": "le la les des et est un une du dans que qui pour pas sur au avec ce".split(),
}


def language(text: Column) -> Column:
    """The language whose stop words occur most, the first by name of equal ones; en for texts of under 20 characters or without any."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}]+"), F.lit(0))
    of = lambda stop: F.size(F.filter(found, lambda w: w.isin(stop)))
    hits = {k: of(v) for k, v in STOP.items()}
    best = F.greatest(*hits.values())
    out = F.when((F.length(text) < 20) | (best == 0), "en")
    for k, n in hits.items():
        out = out.when(n == best, k)
    return out
