"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import prepare

STOP_WORDS = (
    "a al als an and are as at auf aus avec be by con da das de del dem den der des die dans du ein eine el elle en er es est et for für from "
    "il im in is ist it la las le les lo los mit nicht no of on ou para par pas por pour que qui se sich sie su sur the this that to un une una "
    "und von was with y zu"
).split()
SPACE = "[ \\t\\n\\r\\f]+"


@dataclass(frozen=True)
class Rule:
    """A measure has to lie between two bounds, if the text has at least `words` words."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    words: int = 1


RULES = (
    Rule("few_words", "n_words", least=1, words=0),
    Rule("word_length", "mean_word_length", least=2, most=12, words=20),
    Rule("symbols", "symbol_ratio", most=0.15, words=10),
    Rule("bars", "bar_ratio", most=0.02, words=10),
    Rule("capitals", "capital_ratio", most=0.3, words=10),
    Rule("few_stop_words", "stop_word_ratio", least=0.05, words=30),
    Rule("stuttering", "stutter_ratio", most=0.2, words=10),
    Rule("repeated_lines", "repeated_line_ratio", most=0.4, words=20),
    Rule("digits", "digit_ratio", most=0.3, words=20),
)


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole with 6 digits, 0 if there is no whole."""
    return F.round(F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0)), 6)


def _size(x: Column) -> Column:
    return F.size(x).cast("long")


def compiled(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that are broken, in the table's order and divided by commas."""

    def broken(r: Rule) -> Column:
        out = F.lit(False)
        if r.least is not None:
            out = out | (F.col(r.measure) < F.lit(float(r.least)))
        if r.most is not None:
            out = out | (F.col(r.measure) > F.lit(float(r.most)))
        return F.when(out & (F.col("n_words") >= r.words), F.lit(r.name))

    return F.concat_ws(",", *[broken(r) for r in rules])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures of the whole text, the broken rules, and kept (whether none is) for every row of docs.

    Words are divided by white space; for stop words they are runs of letters and numbers in lower case. A word
    stutters if it equals the one before it, case aside. Null and empty texts have no words, all ratios 0, and break
    few_words. A bound itself is kept. Rows aren't compared, so repeated rows and null ids are judged like others; other
    columns are not read. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        text.alias("text"),
        F.filter(F.split(F.lower(text), SPACE), lambda x: x != "").alias("words"),
        F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)).alias("tokens"),
        F.split(text, "\n", -1).alias("lines"),
    )
    left = lambda drop: F.length(F.regexp_replace("text", drop, "")).cast("long")
    counted = split.select(
        "doc_id",
        _size(F.col("words")).alias("n_words"),
        F.length("text").cast("long").alias("n_chars"),
        _size(F.col("tokens")).alias("n_tokens"),
        _size(F.filter("tokens", lambda x: x.isin(STOP_WORDS))).alias("stops"),
        _size(F.filter("words", lambda x, i: (i > 0) & (x == F.get("words", i - 1)))).alias("stutters"),
        _size(F.col("lines")).alias("n_lines"),
        _size(F.array_distinct("lines")).alias("distinct_lines"),
        left(SPACE).alias("visible"),
        left("[\\p{L}\\p{M}\\p{N} \\t\\n\\r\\f]+").alias("symbols"),
        left("[^|]+").alias("bars"),
        left("[^\\p{L}]+").alias("letters"),
        left("[^\\p{Lu}]+").alias("capitals"),
        left("[^0-9]+").alias("digits"),
    )
    col = F.col
    measured = counted.select(
        "doc_id",
        "n_chars",
        "n_words",
        _ratio(col("visible"), col("n_words")).alias("mean_word_length"),
        _ratio(col("symbols"), col("n_chars")).alias("symbol_ratio"),
        _ratio(col("bars"), col("n_chars")).alias("bar_ratio"),
        _ratio(col("capitals"), col("letters")).alias("capital_ratio"),
        _ratio(col("stops"), col("n_tokens")).alias("stop_word_ratio"),
        _ratio(col("stutters"), col("n_words")).alias("stutter_ratio"),
        _ratio(col("n_lines") - col("distinct_lines"), col("n_lines")).alias("repeated_line_ratio"),
        _ratio(col("digits"), col("n_chars")).alias("digit_ratio"),
    )
    return measured.withColumn("broken", compiled(rules)).withColumn("kept", F.col("broken") == "")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same as DuckDB SQL, from the same table."""
    ratio = lambda part, whole, name: f"round(CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / {whole} ELSE 0 END, 6) AS {name}"
    left = lambda drop, name: f"length(regexp_replace(t, '{drop}', '', 'g')) AS {name}"
    cases = []
    for r in rules:
        bounds = [f"{r.measure} {sign} {float(bound)}" for sign, bound in (("<", r.least), (">", r.most)) if bound is not None]
        cases.append(f"CASE WHEN ({' OR '.join(bounds)}) AND n_words >= {r.words} THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SPACE}'), lambda x: x <> '') AS words,
             regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS tokens, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, len(words) AS n_words, length(t) AS n_chars, len(tokens) AS n_tokens, len(list_filter(tokens, lambda x: x IN ({stops}))) AS stops,
        len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) AS stutters, len(lines) AS n_lines, len(list_distinct(lines)) AS distinct_lines,
        {left(SPACE, "visible")}, {left("[\\p{L}\\p{M}\\p{N} \\t\\n\\r\\f]+", "symbols")}, {left("[^|]+", "bars")},
        {left("[^\\p{L}]+", "letters")}, {left("[^\\p{Lu}]+", "capitals")}, {left("[^0-9]+", "digits")} FROM s),
m AS (SELECT doc_id, n_chars, n_words, {ratio("visible", "n_words", "mean_word_length")}, {ratio("symbols", "n_chars", "symbol_ratio")},
        {ratio("bars", "n_chars", "bar_ratio")}, {ratio("capitals", "letters", "capital_ratio")}, {ratio("stops", "n_tokens", "stop_word_ratio")},
        {ratio("stutters", "n_words", "stutter_ratio")}, {ratio("n_lines - distinct_lines", "n_lines", "repeated_line_ratio")}, {ratio("digits", "n_chars", "digit_ratio")} FROM c),
b AS (SELECT *, concat_ws(',', {", ".join(cases)}) AS broken FROM m)
SELECT *, broken = '' AS kept FROM b
"""
