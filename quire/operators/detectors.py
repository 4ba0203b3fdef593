"""Detectors over blocks and pages: font census, columns, notes at the foot, quotes, headings, triage, error rates, evidence."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.functions import vocabulary
from quire.operators.words import listed

PAGE_WIDTH = 612.0


def metadata(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, title, author, authors, language, page_count; empty values are null."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return docs.join(n, "doc_id").select("doc_id", full("title").alias("title"), full("author").alias("author"), F.array_join(F.array_compact(F.array(full("author"))), ",").alias("authors"), F.lit("en").alias("language"), "page_count")


def font_census(blocks: DataFrame) -> DataFrame:
    """doc_id, font_name, font_size, flags, n, role: body for the most frequent style, larger for sizes over it by more than 1."""
    g = blocks.where(F.trim("text") != "").groupBy("doc_id", "font_name", "font_size", "flags").agg(F.count("*").alias("n"))
    body = F.min_by("font_size", F.struct(-F.col("n"), "font_name", "font_size", "flags")).over(Window.partitionBy("doc_id"))
    g = g.withColumn("_b", body)
    return g.select("doc_id", "font_name", "font_size", "flags", "n", F.when(F.col("font_size") > F.col("_b") + 1, "larger").when(F.col("font_size") == F.col("_b"), "body").otherwise("smaller").alias("role"))


def columns(blocks: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """doc_id, page_index, n_left, n_right, two_columns: over two blocks on either side of the middle, and neither side twice the other."""
    middle = (F.col("x0") + F.col("x1")) / 2 < width / 2
    g = blocks.where(F.trim("text") != "").groupBy("doc_id", "page_index").agg(F.count_if(middle).alias("n_left"), F.count_if(~middle).alias("n_right"))
    l, r = F.col("n_left"), F.col("n_right")
    return g.withColumn("two_columns", (l > 2) & (r > 2) & (F.abs(l - r) < 0.5 * F.greatest(l, r)))


def foot_notes(blocks: DataFrame, share: float = 0.75, smaller: float = 0.85) -> DataFrame:
    """Blocks in the lowest part of a page, whose size is less than that of most characters of the page or that begin with a marker."""
    page = Window.partitionBy("doc_id", "page_index")
    b = blocks.withColumn("_h", F.max("y1").over(page)).withColumn("_s", F.max("font_size").over(page))
    marked = F.regexp_like("text", F.lit("^[ \\t]*([0-9]{1,3}|[*†‡¹²³])[ .)]"))
    return b.where((F.col("y0") > share * F.col("_h")) & ((F.col("font_size") < smaller * F.col("_s")) | marked)).select("doc_id", "page_index", "block_no", "text")


def block_quotes(blocks: DataFrame, indent: float = 100.0, least: int = 50) -> DataFrame:
    """doc_id, page_index, block_no, depth of long blocks that are set in."""
    some = blocks.where((F.col("x0") > indent) & (F.length("text") > least))
    return some.select("doc_id", "page_index", "block_no", F.floor((F.col("x0") - 72.0) / 36.0).cast("int").alias("depth"))


def heading_votes(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """doc_id, page_index, block_no, score of blocks with at least half of the votes of size, weight, place and length."""
    b = blocks.where(F.trim("text") != "").join(body.select("doc_id", F.col("size").alias("_b")), "doc_id")
    score = (
        F.when(F.col("font_size") > F.col("_b") * 1.2, 0.4).otherwise(0.0) + F.when(F.col("flags").bitwiseAND(16) != 0, 0.3).otherwise(0.0)
        + F.when(F.col("block_no") == 0, 0.2).otherwise(0.0) + F.when(F.length("text") < 80, 0.1).otherwise(0.0)
    )
    return b.select("doc_id", "page_index", "block_no", F.round(score, 6).alias("score")).where("score >= 0.5")


def outline_matches(outline: DataFrame, pages: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, seq, line_no, kind: the first line of an entry's page, among the first ones with text, that is its title, holds it, or shares its words."""
    lines = pages.select("doc_id", "page_index", F.posexplode(F.slice(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), 1, most)).alias("line_no", "line"))
    both = outline.join(lines, ["doc_id", "page_index"])
    t, x = F.lower(F.trim("title")), F.lower(F.trim("line"))
    long = lambda c: F.array_distinct(F.filter(tx.words(c), lambda w: F.length(w) > 2))
    shared = F.size(F.array_intersect(long(t), long(x))) >= 0.8 * F.size(long(t))
    kind = F.when(t == x, "exact").when((F.length(t) > 10) & F.contains(x, t), "within").when((F.size(long(t)) > 0) & shared, "words")
    hit = both.withColumn("kind", kind).where("kind IS NOT NULL")
    return hit.groupBy("doc_id", "seq").agg(F.min(F.struct("line_no", "kind")).alias("m")).select("doc_id", "seq", "m.line_no", "m.kind")


def error_rates(pages: DataFrame, lex: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, page_index, n_words, n_unknown, rate: distinct unknown words of three letters or more by all words; pages of few words are left out."""
    whole = pages.select("doc_id", "page_index", "text").repartition("doc_id")  # words are counted where their page is
    found = whole.select("doc_id", "page_index", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]{3,}"), F.lit(0))).alias("word"))
    counts = found.groupBy("doc_id", "page_index", "word").agg(F.count("*").alias("n"))
    marked = counts.join(listed(lex.select("word", F.lit(True).alias("known"))), "word", "left")
    g = marked.groupBy("doc_id", "page_index").agg(F.sum("n").alias("n_words"), F.count_if(F.col("known").isNull()).alias("n_unknown"))
    return g.where(F.col("n_words") >= least).withColumn("rate", F.round(F.col("n_unknown") / F.col("n_words"), 6))


def triage(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, action, reason: blank, short and clean pages are skipped, others reviewed."""
    n = F.size(tx.words(F.col("text")))
    marks = F.lit(0).cast("long")
    for c in tx.mark_counts(F.col("text")).values():
        marks = marks + c
    reason = F.when(n == 0, "blank").when(n < 10, "short").when(marks == 0, "clean").otherwise("marks")
    return pages.select("doc_id", "page_index", F.when(reason == "marks", "REVIEW").otherwise("SKIP").alias("action"), reason.alias("reason"))


def triage_totals(t: DataFrame) -> DataFrame:
    g = t.groupBy("doc_id").agg(F.count_if(F.col("action") == "SKIP").alias("skipped"), F.count_if(F.col("action") == "REVIEW").alias("reviewed"))
    return g.withColumn("saved", F.round(100 * F.col("skipped") / (F.col("skipped") + F.col("reviewed")), 6))


def skip_reasons(tokens: DataFrame, lex: DataFrame) -> DataFrame:
    """reason, n: why tokens are no candidates of correction, by the first rule that holds."""
    w = tokens.groupBy("token", "word").agg(F.count("*").alias("n")).join(lex.select("word", F.lit(True).alias("known")), "word", "left")
    reason = (
        F.when(F.length("word") < 4, "short").when(F.regexp_like("word", F.lit("[0-9]")), "number").when(F.col("known"), "known").when(F.col("word").isin(sorted(vocabulary.CORRECTION)), "scholarly")
        .when(tx.is_all_caps(F.col("token")), "capitals").when(F.regexp_like("token", F.lit("^\\p{Lu}")), "name").when(tx.is_foreign(F.col("word")), "foreign").otherwise("candidate")
    )
    return w.groupBy(reason.alias("reason")).agg(F.sum("n").alias("n"))


_PART = "[\\p{L}\\p{N}_'-]"
#: Tried at the first letter of a word and at quotes, where the first match begins.
_PAIR = f"(?:(?<!{_PART})|(?=\"))[\"']?({_PART}+)[\"']?[ \\t]*(?:→|->)[ \\t]*[\"']?({_PART}+)"


def error_pairs(notes: DataFrame, evidence: Column) -> DataFrame:
    """notes with wrong and right of evidence of the form 'wrong → right'; others are left out. The note is searched once."""
    found = notes.select("*", F.explode(F.array(F.regexp_extract(evidence, _PAIR, 0))).alias("_m")).where("_m <> ''")
    part = lambda k: F.regexp_extract("_m", _PAIR, k)
    return found.withColumns({"wrong": part(1), "right": part(2)}).drop("_m")


def _same(x: Sequence, y: Sequence, i: int, j: int) -> int:
    """Where in x its run of items equal to those of y ends, from x[i] and y[j] on."""
    step, most = 1, min(len(x) - i, len(y) - j)
    end = i + max(most, 0)
    while i < end and x[i : min(i + step, end)] == y[j : j + min(step, end - i)]:
        step = min(step, end - i)
        i, j, step = i + step, j + step, 2 * step
    while step > 1 and i < end:
        step //= 2
        if i + step <= end and x[i : i + step] == y[j : j + step]:
            i, j = i + step, j + step
    return i


def _few_edits(x: Sequence, y: Sequence, most: int) -> int | None:
    """Edit distance if it is at most `most`, by the furthest place that each number of edits reaches on each diagonal."""
    reach, goal = {0: _same(x, y, 0, 0)}, len(y) - len(x)
    for e in range(most + 1):
        if reach.get(goal, -1) >= len(x):
            return e
        ahead = {}
        for k in range(-e - 1, e + 2):
            i = min(max(reach.get(k, -2) + 1, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1), len(x), len(y) - k)
            if i >= 0 and i + k >= 0:
                ahead[k] = _same(x, y, i, i + k)
        reach = ahead
    return None


def edits(x: Sequence, y: Sequence) -> int:
    """Edit distance of two sequences, whole: by diagonals if it is small, else by columns held as the bits of integers (Myers)."""
    start, n, m = 0, len(x), len(y)
    while start < n and start < m and x[start] == y[start]:
        start += 1
    while n > start and m > start and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    x, y = x[start:n], y[start:m]
    if not x or not y:
        return len(x) + len(y)
    if (few := _few_edits(x, y, int(2 * min(len(x), len(y)) ** 0.5))) is not None:
        return few
    if len(x) > len(y):
        x, y = y, x
    where: dict[object, bytearray] = {}
    for i, c in enumerate(x):
        where.setdefault(c, bytearray(len(x) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    peq = {c: int.from_bytes(b, "little") for c, b in where.items()}
    mask, last, far = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = mask, 0
    for c in y:
        eq = peq.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (mask & ~(flat | up)), up & flat
        far += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & mask, (left << 1) & mask
        vertical = eq | down
        up, down = left | (mask & ~(vertical | right)), right & vertical
    return far


@F.pandas_udf(T.DoubleType())
def word_error_rate(truth: pd.Series, other: pd.Series) -> pd.Series:
    """Edit distance over words by the number of the truth's words, in lower case; 0 or 1 without any."""

    def rate(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        x, y = a.lower().split(), b.lower().split()
        return edits(x, y) / len(x) if x else float(bool(y))

    return pd.Series([rate(a, b) for a, b in zip(truth, other)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def character_error_rate(truth: pd.Series, other: pd.Series) -> pd.Series:
    """Edit distance by the length of the truth, in lower case, of texts of any length; 0 or 1 without any."""

    def rate(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        return edits(a.lower(), b.lower()) / len(a) if a else float(bool(b))

    return pd.Series([rate(a, b) for a, b in zip(truth, other)], dtype="float64")
