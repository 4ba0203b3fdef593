"""Surveys and metrics: quality classes, roll-ups, confusion metrics, parameter sweeps, samples, batches, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx

CLASSES = ("GOOD", "MARGINAL", "BAD")
BUCKETS = ((0.01, "A"), (0.03, "B"), (0.05, "C"), (0.10, "D"))
RATES = {"A": 0.1, "B": 0.2, "C": 0.5, "D": 0.75, "E": 1.0}


def page_quality(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, n_words, n_chars, n_garbage, garbage, valid, issues, verdict of each page, in one projection.

    garbage is n_garbage by n_chars. A page of white space has no text layer: no characters, and that as its only issue. Issues that
    images would show aren't known here. verdict is this package's own class of a page, by garbage and valid.
    """
    text, low = F.col("text"), F.col("low")
    blank = ~F.regexp_like("text", F.lit("[^ \\t\\n\\r\\f]"))
    has = lambda of, pattern: F.regexp_like(of, F.lit(pattern))
    # what several columns need is a column of its own: an expression in branches is worked out in each of them
    p = pages.select("doc_id", "page_index", "text", F.lower("text").alias("low"), blank.alias("blank"), F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")).alias("n_words"), F.regexp_like("text", F.lit(tx.ODD)).alias("odd"))
    n, bad = tx.word_counts(low)
    p = p.select("*", tx.garbage(text, F.col("odd")).alias("marks"), n.alias("alpha"), bad.alias("unlike"))
    p = p.select(
        "doc_id", "page_index", "text", "low", "odd", "blank", "n_words", F.when(F.col("blank"), 0).otherwise(F.length(text)).alias("n_chars"), F.when(F.col("blank"), F.lit(0).cast("long")).otherwise(F.col("marks")).alias("n_garbage"),
        F.when(F.col("blank") | (F.col("alpha") == 0), 0.0).otherwise(F.round((F.col("alpha") - F.col("unlike")) / F.col("alpha"), 6)).alias("valid"),
    )
    p = p.withColumn("garbage", F.when(F.col("n_chars") == 0, 0.0).otherwise(F.round(F.col("n_garbage").cast("double") / F.col("n_chars"), 6)))
    raised = "[⁰¹²³⁴⁵⁶⁷⁸⁹]+"
    floating = has(text, raised) & ~has(text, raised + "[ \\t\\n\\r\\f]*$") & has(text, f"[ \\t\\n\\r\\f]{raised}[ \\t\\n\\r\\f]")
    issues = F.array_compact(
        F.array(
            F.when(F.col("odd") & has(text, "[α-ω]{16,}"), "garbled_greek"),
            F.when(has(text, "[äöüÄÖÜß]{2}"), "umlaut_errors"),
            F.when((F.col("page_index") < 50) & ~has(low, tx.whole("[ivxlcdm]{2,}")) & has(low, tx.whole("[1il][vx]")), "roman_numeral_confusion"),
            F.when(F.col("odd") & floating, "floating_superscripts"),
            F.when(has(low, tx.whole("[a-z]{20,}")), "merged_words"),
            F.when(has(text, "[\\p{L}\\p{N}_]-[ \\t\\r\\f]*\\n[ \\t\\n\\r\\f]*[\\p{L}\\p{N}_]"), "broken_hyphenation"),
            F.when(F.col("garbage") > 0.05, "high_garbage_ratio"),
            F.when(F.col("valid") < 0.5, "low_valid_words"),
        )
    )
    verdict = F.when(F.col("n_words") < 10, "SKIP").when((F.col("garbage") > 0.02) | (F.col("valid") < 0.5), "BAD").when((F.col("garbage") > 0.005) | (F.col("valid") < 0.8), "MARGINAL").otherwise("GOOD")
    out = F.struct("doc_id", "page_index", "n_words", "n_chars", "n_garbage", "garbage", "valid", F.when(F.col("blank"), "no_text_layer").otherwise(F.array_join(issues, ",")).alias("issues"), verdict.alias("verdict"))
    # a filter on a verdict doesn't pass the explosion, else it would work out all of its patterns again
    return p.select(F.inline(F.array(out)))


def assess(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, with_text, with_issues, garbage, valid, grade, reason of pages as `page_quality` gives them.

    garbage is over all characters, 1 without any; valid is the mean over the pages that have valid words.
    """
    micro = F.round(F.col("valid") * 1e6).cast("long")
    g = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("issues") != "no_text_layer").alias("with_text"), F.count_if(F.col("issues") != "").alias("with_issues"), F.sum("n_garbage").alias("bad"), F.sum("n_chars").alias("all"),
        F.sum(micro).alias("micro"), F.count_if(F.col("valid") > 0).alias("n_valid"),
    )
    g = g.withColumn("garbage", F.when(F.col("all") == 0, 1.0).otherwise(F.col("bad") / F.col("all"))).withColumn("valid", F.when(F.col("n_valid") == 0, 0.0).otherwise(F.col("micro") / F.col("n_valid") / 1e6))
    reason = (
        F.when(F.col("with_text") < F.col("n_pages") * 0.5, "text_layer").when(F.col("garbage") > 0.1, "garbage").when(F.col("valid") < 0.6, "words").when(F.col("with_issues") > F.col("n_pages") * 0.3, "issues").otherwise("usable")
    )
    grade = F.when(reason.isin("text_layer", "garbage"), "POOR").when(reason.isin("words", "issues"), "DEGRADED").otherwise("ACCEPTABLE")
    return g.select("doc_id", "n_pages", "with_text", "with_issues", F.round("garbage", 6).alias("garbage"), F.round("valid", 6).alias("valid"), grade.alias("grade"), reason.alias("reason"))


def issue_counts(pages: DataFrame) -> DataFrame:
    """doc_id, issue, n: a histogram of the issues of a document's pages."""
    return pages.where("issues <> ''").select("doc_id", F.explode(F.split("issues", ",")).alias("issue")).groupBy("doc_id", "issue").agg(F.count("*").alias("n"))


def classes(pages: DataFrame) -> DataFrame:
    """doc_id, class, n, percent, pages: counts and lists of pages by class; other classes are left out."""
    c = pages.withColumn("class", F.upper("verdict")).where(F.col("class").isin(*CLASSES))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    g = c.groupBy("doc_id", "class").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("page_index")), lambda x: x.cast("string")), ",").alias("pages"))
    return g.select("doc_id", "class", "n", F.round(100 * F.col("n") / total, 6).alias("percent"), "pages")


def corpus_statistics(pages: DataFrame) -> DataFrame:
    """Totals of each document and, with a null doc_id, of the corpus, in one pass."""
    return pages.rollup("doc_id").agg(F.count("*").alias("n_pages"), F.sum("n_words").alias("n_words"), (F.sum(F.round(F.col("garbage") * 1e6).cast("long")) / F.count("*") / 1e6).alias("garbage"), F.count_if(F.col("verdict") == "BAD").alias("bad"))


def summary(pages: DataFrame) -> DataFrame:
    """dimension, value, n: counts by verdict, by issue-freedom and in all, by grouping sets."""
    p = pages.withColumn("clean", (F.col("issues") == "").cast("string"))
    g = p.groupingSets([["verdict"], ["clean"], []], "verdict", "clean").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "verdict").when(F.col("g") == 2, "clean").otherwise("all").alias("dimension"), F.coalesce("verdict", "clean", F.lit("")).alias("value"), "n")


def _metrics(counts: DataFrame, *key: str) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(*key, "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), F.round(ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"))


def _confusion(said: Column, true: Column) -> list[Column]:
    return [F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn")]


def confusion(rows: DataFrame) -> DataFrame:
    """Counts and rates of rows (said, truth)."""
    return _metrics(rows.agg(*_confusion(F.col("said"), F.col("truth"))))


def thresholds(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Metrics of rows (score, truth) at each threshold of the grid, best f1 first; the grid is a table of parameters."""
    said = F.col("score") >= F.col("threshold")
    counts = rows.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(*_confusion(said, F.col("truth")))
    return _metrics(counts, "threshold").orderBy(F.desc("f1"), "threshold")


def buckets(rate: Column) -> Column:
    out = None
    for bound, name in BUCKETS:
        out = F.when(rate < bound, name) if out is None else out.when(rate < bound, name)
    return out.otherwise("E")


def stratified(rows: DataFrame, key: str, bucket: str = "bucket") -> DataFrame:
    """An exact share of each bucket, at least one row, in the order of a hash of the key."""
    rate = F.lit(1.0)
    for name, r in RATES.items():
        rate = F.when(F.col(bucket) == name, r).otherwise(rate)
    by = Window.partitionBy(bucket)
    ranked = rows.withColumn("_n", F.count("*").over(by)).withColumn("_k", F.row_number().over(by.orderBy(F.md5(F.col(key).cast("string")), F.col(key))))
    return ranked.where(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * rate))).drop("_n", "_k")


def batches(rows: DataFrame, key: str, size: int, within: str) -> DataFrame:
    """rows with `batch`, from 1, of at most `size` rows of one group."""
    k = F.row_number().over(Window.partitionBy(within).orderBy(key))
    return rows.withColumn("batch", (F.floor((k - 1) / size) + 1).cast("int"))


def evenly(items: Column, n: int) -> Column:
    """n items spread evenly over an array, or all if it has no more."""
    step = F.size(items) / F.lit(n)
    return F.when(F.size(items) <= n, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(items, F.floor(i * step).cast("int"))))


def agreement(outline: DataFrame, headings: DataFrame, contents: DataFrame) -> DataFrame:
    """doc_id, page_index, agree: which sources have a candidate within a page of each page that any has one on."""

    def near(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc_id", F.explode(F.sequence(F.col("page_index") - 1, F.col("page_index") + 1)).alias("page_index"), F.lit(name).alias("source"))

    sources = {"outline": outline, "headings": headings, "contents": contents}
    exact, spread = None, None
    for name, df in sources.items():
        e = df.select("doc_id", "page_index").distinct()
        s = near(e, name)
        exact, spread = (e, s) if exact is None else (exact.unionByName(e), spread.unionByName(s))
    found = exact.distinct().join(spread, ["doc_id", "page_index"]).groupBy("doc_id", "page_index").agg(*[F.max((F.col("source") == n).cast("int")).alias(n) for n in sources])
    name = F.concat_ws("+", *[F.when(F.col(n) == 1, n) for n in sources])
    return found.select("doc_id", "page_index", name.alias("agree"))


def linkage(markers: DataFrame, contents: DataFrame) -> DataFrame:
    """doc_id, id, problem: markers without content, and content without a marker."""
    a = markers.select("doc_id", F.col("target_id").alias("id")).distinct()
    b = contents.select("doc_id", F.col("note_id").alias("id")).distinct()
    lone = a.join(b, ["doc_id", "id"], "left_anti").withColumn("problem", F.lit("no content"))
    return lone.unionByName(b.join(a, ["doc_id", "id"], "left_anti").withColumn("problem", F.lit("no marker")))


def page_jumps(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, label: arabic labels that neither follow the one before nor are 1."""
    number = F.expr("try_cast(label AS int)")
    numbered = pages.withColumn("_n", number).where("_n IS NOT NULL")
    before = F.lag("_n").over(Window.partitionBy("doc_id").orderBy("page_index"))
    return numbered.withColumn("_b", before).where("_b IS NOT NULL AND _n <> _b + 1 AND _n <> 1").select("doc_id", "page_index", "label")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """The first of pairs (seq, wrong, right) that are equal in lower case; pairs of equal words are left out."""
    low = pairs.where(F.lower("wrong") != F.lower("right"))
    k = F.row_number().over(Window.partitionBy(F.lower("wrong"), F.lower("right")).orderBy("seq"))
    return low.withColumn("_k", k).where("_k = 1").drop("_k")


def distinct_headings(c: DataFrame) -> DataFrame:
    """The first candidate of each page and beginning of title."""
    k = F.row_number().over(Window.partitionBy("doc_id", "page_index", F.lower(F.substring("title", 1, 30))).orderBy("seq", "source"))
    return c.withColumn("_k", k).where("_k = 1").drop("_k")


#: Letters whose presence is compared before edits are counted: an edit changes two of them at most.
LETTERS = "etaonirslducmpgh"


def _letters(word: Column) -> Column:
    """The set of LETTERS in a word, as bits."""
    bits = F.lit(0)
    for k, c in enumerate(LETTERS):
        bits = bits + F.when(F.contains(word, F.lit(c)), 1 << k).otherwise(0)
    return bits


def similar_words(counts: DataFrame, most: int = 2, times: int = 3) -> DataFrame:
    """doc_id, word, other, n, m: words whose neighbour within two edits is much more frequent in the same document.

    Each word of a document meets its frequent words in place, within the document's row: no pair and no form is shuffled, and
    length and letters decide for most pairs. The work grows with the square of one document's vocabulary, never of the corpus'.
    Words of any length take part.
    """
    if not 0 <= most <= 2:
        raise ValueError("words of up to two edits are compared")
    w = counts.where("doc_id IS NOT NULL AND word IS NOT NULL").select("doc_id", F.struct("word", "n", F.length("word").alias("size"), _letters(F.col("word")).alias("letters")).alias("w"))
    by_doc = w.groupBy("doc_id").agg(F.collect_list("w").alias("all"), F.collect_list(F.when(F.col("w.n") >= times, F.col("w"))).alias("often"))
    met = by_doc.select("doc_id", F.explode("all").alias("a"), "often").select("doc_id", "a", F.explode("often").alias("b"))
    may = (F.abs(F.col("a.size") - F.col("b.size")) <= most) & (F.col("b.n") >= times * F.col("a.n")) & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2 * most) & (F.col("a.word") != F.col("b.word"))
    found = met.where(may).select("doc_id", F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("m"))
    return found.where(F.levenshtein("word", "other", most) >= 0)


def outline_quality(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, n, depth, coverage: entries, deepest level, and the share of pages that an entry points at."""
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    g = outline.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("level").alias("depth"), F.countDistinct("page_index").alias("hit"))
    return g.join(counted, "doc_id").select("doc_id", "n", "depth", F.round(F.col("hit") / F.col("n_pages"), 6).alias("coverage"))


#: Patterns of samples: family, name, pattern.
PATTERNS = (
    ("german", "umlaut", "[\\p{L}]*[äöüß][\\p{L}]*"),
    ("french", "accent", "[\\p{L}]*[éèêçà][\\p{L}]*"),
    ("citation", "year", "\\([A-Z][a-z]+,? [0-9]{4}\\)"),
    ("citation", "bracket", "\\[[0-9]+\\]"),
    ("cross_reference", "see", "[Ss]ee (chapter|section|page|p\\.) ?[0-9]+"),
    ("hyphenation", "break", "[\\p{L}]+-\\n[\\p{L}]+"),
    ("confusion", "capitals", tx.CAPS),
    ("confusion", "digits", "[a-zA-Z]+[0-9]+[a-zA-Z]+"),
    ("punctuation", "doubled", "[.,;:]{2,}"),
    ("names", "capitalized", "[A-Z][a-z]+ [A-Z][a-z]+"),
)


def samples(pages: DataFrame, patterns: tuple[tuple[str, str, str], ...] = PATTERNS, most: int = 3, around: int = 80) -> DataFrame:
    """doc_id, page_index, family, name, found, context: the first match of each pattern on a page, at most `most` of a family there."""
    hits = F.array_compact(
        F.array(*[F.when(F.regexp_like("text", F.lit(p)), F.struct(F.lit(k).alias("k"), F.lit(f).alias("family"), F.lit(n).alias("name"), F.regexp_extract("text", f"({p})", 1).alias("found"))) for k, (f, n, p) in enumerate(patterns)])
    )
    each = pages.select("doc_id", "page_index", "text", F.explode(hits).alias("h")).select("doc_id", "page_index", "text", "h.*")
    at = F.expr("locate(found, text)")
    k = F.row_number().over(Window.partitionBy("doc_id", "page_index", "family").orderBy("k"))
    context = F.substring(F.col("text"), F.greatest(at - around, F.lit(1)), at - F.greatest(at - around, F.lit(1)) + F.length("found") + around)
    return each.withColumn("_k", k).where(F.col("_k") <= most).select("doc_id", "page_index", "family", "name", "found", context.alias("context"))
