"""Lexicon, membership, morphology, error detection, line breaks: token tables, judged once for each distinct word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import vocabulary

LEAST_DOCS, LEAST_WORD, LEARNED, MAX_CONTEXTS = 5, 2, 0.7, 5


def lexicon(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """word, doc_freq, freq, zipf (log10 of the frequency in a billion words) of words that enough documents hold.

    The texts of one document are brought together first, so that its words are counted where they are and only counts move.
    """
    texts = docs.select("doc_id", "text").repartition("doc_id")
    found = texts.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]+"), F.lit(0))).alias("word"))
    by_doc = found.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    counts = by_doc.groupBy("word").agg(F.count("doc_id").alias("doc_freq"), F.sum("n").alias("freq"))
    total = texts.agg(F.sum(F.regexp_count(F.lower("text"), F.lit("[\\p{L}]+"))).alias("total"))
    joined = counts.where(F.col("doc_freq") >= least_docs).crossJoin(F.broadcast(total))  # one row
    return joined.select("word", "doc_freq", "freq", F.log10(F.col("freq") * 1e9 / F.col("total")).alias("zipf"))


def tokens(texts: DataFrame) -> DataFrame:
    """doc_id, pos, token, word (cleaned)."""
    cut = texts.select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("pos", "token"))
    return cut.withColumn("word", tx.clean_word(F.col("token")))


def cleaned(texts: DataFrame) -> DataFrame:
    """doc_id, word: the words of `tokens` that aren't empty, cleaned a text at a time, without places."""
    text = F.regexp_replace(tx.composed(F.lower("text")), "[^\\p{L}\\p{N}_' \\t\\n\\r\\f]+", "")
    return texts.select("doc_id", F.explode(F.split(text, tx.SPACE)).alias("word")).select("doc_id", F.btrim("word", F.lit("'")).alias("word")).where("word <> ''")


#: Word lists of up to so many bytes, as Spark estimates them without running anything, go to every executor; longer ones are joined by shuffle.
SMALL = 32 << 20


def few(words: DataFrame) -> bool:
    return int(str(words._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def listed(words: DataFrame) -> DataFrame:
    """words, with the hint to broadcast them if they are few."""
    return F.broadcast(words) if few(words) else words


def _all_known(lex: DataFrame, learned: DataFrame | None = None, least: float = LEARNED) -> DataFrame:
    out = lex.select("word")
    return out if learned is None else out.unionByName(learned.where(F.col("confidence") >= least).select("word")).distinct()


def known(words: DataFrame, lex: DataFrame, learned: DataFrame | None = None, least: float = LEARNED) -> DataFrame:
    """words (word) with `known`: in the lexicon, or learned surely enough."""
    all_known = listed(_all_known(lex, learned, least)).withColumn("known", F.lit(True))
    return words.join(all_known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _rules(word: Column) -> Column:
    """All (order, base, score) that a word's endings and beginnings give."""
    out = []
    n = F.length(word)
    for k, (s, score) in enumerate(vocabulary.SUFFIXES):
        base = F.substring(word, F.lit(1), n - len(s))
        ok = F.endswith(word, F.lit(s)) & (n > len(s) + 3)
        out.append(F.when(ok, F.struct(F.lit(4 * k).alias("order"), base.alias("base"), F.lit(score).alias("score"))))
        if s in ("ing", "ed"):
            out.append(F.when(ok, F.struct(F.lit(4 * k + 1).alias("order"), F.substring(base, F.lit(1), F.length(base) - 1).alias("base"), F.lit(round(score * 0.9, 6)).alias("score"))))
        if s[:2] in ("iz", "is"):
            out += [F.when(ok, F.struct(F.lit(4 * k + j).alias("order"), F.concat(base, F.lit(e)).alias("base"), F.lit(score).alias("score"))) for j, e in ((2, "ize"), (3, "ise"))]
    for k, (p, score) in enumerate(vocabulary.PREFIXES):
        rest = F.substring(word, F.lit(len(p) + 1), n)
        out.append(F.when(F.startswith(word, F.lit(p)) & (n > len(p) + 3), F.struct(F.lit(1000 + k).alias("order"), rest.alias("base"), F.lit(score).alias("score"))))
    return F.array_compact(F.array(*out))


def morphology(words: DataFrame, lex: DataFrame) -> DataFrame:
    """word, morphology: the score of the first rule whose base is in the lexicon; words without any have no row."""
    tried = words.select("word").distinct().select("word", F.explode(_rules(F.col("word"))).alias("r")).select("word", "r.order", F.col("r.base").alias("base"), "r.score")
    hit = tried.join(listed(lex.select(F.col("word").alias("base"))), "base", "left_semi")
    return hit.groupBy("word").agg(F.min_by("score", "order").alias("morphology"))


def judge(words: DataFrame, lex: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """word, known, morphology, pattern, confidence, valid of each distinct word.

    Words and the bases of their rules are looked up together, so that `words` is read once.
    """
    itself = F.struct(F.lit(-1).alias("order"), F.col("word").alias("base"), F.lit(0.0).alias("score"))
    tried = words.select("word").distinct().select("word", F.explode(F.concat(F.array(itself), _rules(F.col("word")))).alias("r")).select("word", "r.order", F.col("r.base").alias("base"), "r.score")
    of = lex.select(F.col("word").alias("base"), F.lit(True).alias("_in"))
    found = tried.join(listed(of), "base", "left")
    w = found.groupBy("word").agg(
        F.coalesce(F.bool_or((F.col("order") < 0) & F.col("_in")), F.lit(False)).alias("known"),
        F.coalesce(F.min_by("score", F.when(F.col("_in") & (F.col("order") >= 0), F.col("order"))), F.lit(0.0)).alias("morphology"),
    )
    if learned is not None:
        sure = learned.where(F.col("confidence") >= LEARNED).select("word", F.lit(True).alias("_sure")).distinct()
        w = w.join(sure, "word", "left").withColumn("known", F.col("known") | F.coalesce("_sure", F.lit(False))).drop("_sure")
    w = w.withColumn("pattern", tx.pattern_score(F.col("word")))
    confidence = F.when(F.col("known"), 1.0).otherwise(F.round(F.least(F.col("morphology") + F.col("pattern") * 0.3, F.lit(1.0)), 6))
    return w.withColumn("confidence", confidence).withColumn("valid", F.col("known") | (F.col("confidence") >= 0.5))


def scholarly(word: Column, more: tuple[str, ...] = ()) -> Column:
    return word.isin(sorted(vocabulary.DETECTION | {m.lower() for m in more}))


def detect(toks: DataFrame, lex: DataFrame, mode: str = "new", more: tuple[str, ...] = (), learned: DataFrame | None = None, least_length: int = LEAST_WORD) -> DataFrame:
    """toks with `status`: short, scholarly, valid or error, and `confidence` of errors.

    `new` takes every unknown word for an error, `legacy` lets words pass that look valid. Words are judged once each.
    """
    if mode not in ("new", "legacy"):
        raise ValueError(f"no mode {mode!r}")
    verdict = judge(toks.where(F.length("word") >= least_length), lex, learned)
    joined = toks.join(verdict.select("word", "known", "valid", F.col("confidence").alias("c")), "word", "left")
    fine = F.col("known") if mode == "new" else F.col("valid")
    status = F.when(F.length("word") < least_length, "short").when(scholarly(F.col("word"), more), "scholarly").when(fine, "valid").otherwise("error")
    out = joined.withColumn("status", status)
    return out.withColumn("confidence", F.when(F.col("status") == "error", F.round(1 - F.col("c"), 6))).drop("known", "valid", "c")


def errors(texts: DataFrame, lex: DataFrame, mode: str = "new") -> DataFrame:
    """doc_id, pos, token, word, confidence of the errors that `detect` finds: only unknown words are judged and shuffled."""
    if mode not in ("new", "legacy"):
        raise ValueError(f"no mode {mode!r}")
    doubtful = (F.length("word") >= LEAST_WORD) & ~scholarly(F.col("word"))
    unknown = lambda df: df.where(doubtful).join(listed(lex.select("word")), "word", "left_anti")
    verdict = judge(unknown(cleaned(texts)), lex)
    if mode == "legacy":
        verdict = verdict.where(~F.col("valid"))
    found = unknown(tokens(texts)).join(verdict.select("word", F.round(1 - F.col("confidence"), 6).alias("confidence")), "word")
    return found.select("doc_id", "pos", "token", "word", "confidence")


def statistics(detected: DataFrame) -> DataFrame:
    """doc_id and the numbers of words by status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return detected.groupBy("doc_id").agg(F.count("*").alias("words_checked"), n("short").alias("skipped_short"), n("scholarly").alias("skipped_scholarly"), n("valid").alias("skipped_valid"), n("error").alias("errors"))


def text_statistics(texts: DataFrame, lex: DataFrame, mode: str = "new", more: tuple[str, ...] = (), learned: DataFrame | None = None, least_length: int = LEAST_WORD, least_confidence: float = 0.0) -> DataFrame:
    """`statistics` of what `detect` finds in texts, where errors of less than `least_confidence` count as valid.

    Words are counted within their document, and only the counts of unknown words leave it; they are judged where that decides.
    """
    if mode not in ("new", "legacy"):
        raise ValueError(f"no mode {mode!r}")
    texts = texts.select("doc_id", "text").repartition("doc_id")
    n = F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f]+")).cast("long")
    total = texts.groupBy("doc_id").agg(F.sum(n).alias("words_checked")).where("words_checked > 0")
    counts = cleaned(texts).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    counts = counts.where(F.length("word") >= least_length)
    term = scholarly(F.col("word"), more)
    known_words = lex.select("word")
    if learned is None and mode == "new" and least_confidence <= 0 and few(known_words):  # one pass, in place
        marked = counts.join(F.broadcast(known_words.withColumn("known", F.lit(True))), "word", "left")
        wrong = F.sum(F.when(~term & F.col("known").isNull(), F.col("n"))).alias("errors")
        by_doc = marked.groupBy("doc_id").agg(F.sum("n").alias("long"), F.sum(F.when(term, F.col("n"))).alias("terms"), wrong)
        return _by_status(total.join(by_doc, "doc_id", "left"))
    by_doc = counts.groupBy("doc_id").agg(F.sum("n").alias("long"), F.sum(F.when(term, F.col("n"))).alias("terms"))
    unknown = counts.where(~term).join(listed(known_words), "word", "left_anti")
    if learned is not None or mode == "legacy" or least_confidence > 0:
        verdict = judge(unknown, lex, learned)
        wrong = ~F.col("known" if mode == "new" else "valid") & (F.round(1 - F.col("confidence"), 6) >= least_confidence)
        unknown = unknown.join(verdict.where(wrong).select("word"), "word", "left_semi")
    wrong = unknown.groupBy("doc_id").agg(F.sum("n").alias("errors"))
    return _by_status(total.join(by_doc, "doc_id", "left").join(wrong, "doc_id", "left"))


def _by_status(counts: DataFrame) -> DataFrame:
    out = counts.na.fill(0, ["long", "terms", "errors"])
    return out.select("doc_id", "words_checked", (F.col("words_checked") - F.col("long")).alias("skipped_short"), F.col("terms").alias("skipped_scholarly"), (F.col("long") - F.col("terms") - F.col("errors")).alias("skipped_valid"), "errors")


def quality_level(stats: DataFrame) -> DataFrame:
    """doc_id, error_rate, level, confidence."""
    rate = F.col("errors") / F.greatest("words_checked", F.lit(1))
    e = F.col("errors") > 0
    level = F.when(e & (rate > 0.05), "bad").when(e & (rate > 0.02), "marginal").otherwise("good")
    sure = F.when(~e, 0.95).when(rate > 0.05, 0.5).when(rate > 0.02, 0.7).otherwise(0.9)
    return stats.select("doc_id", F.round(rate, 6).alias("error_rate"), level.alias("level"), sure.alias("confidence"))


# -- line breaks

BREAK = "([\\p{L}\\p{N}_]+)-[ \\t\\r\\f]*\\n[ \\t\\n\\r\\f]*([\\p{L}\\p{N}_]+)"
#: The same matches, but words without a hyphen behind them are passed over once, not from each of their letters.
_QUICK = "(?<![\\p{L}\\p{N}_])[\\p{L}\\p{N}_]++-[ \\t\\r\\f]*\\n[ \\t\\n\\r\\f]*+[\\p{L}\\p{N}_]++"


def break_candidates(texts: DataFrame) -> DataFrame:
    """doc_id, k, fragment1, fragment2, joined of every hyphen at a line's end."""
    found = texts.where(F.contains("text", F.lit("-"))).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_QUICK), F.lit(0))).alias("k", "x"))
    a, b = F.regexp_extract("x", "^[\\p{L}\\p{N}_]+", 0), F.regexp_extract("x", "[\\p{L}\\p{N}_]+$", 0)
    return found.select("doc_id", "k", a.alias("fragment1"), b.alias("fragment2"), F.concat(a, b).alias("joined"))


def block_break_candidates(blocks: DataFrame) -> DataFrame:
    """Hyphens at the end of a line that goes on in the next line of the same page."""
    w = tx.words(F.col("text"))
    lines = blocks.select("doc_id", "page_index", "block_no", F.try_element_at(w, F.lit(-1)).alias("last"), F.try_element_at(w, F.lit(1)).alias("first"))
    by = Window.partitionBy("doc_id", "page_index").orderBy("block_no")
    pairs = lines.where("first IS NOT NULL").withColumn("next", F.lead("first").over(by)).where(F.endswith("last", F.lit("-")) & (F.length("last") > 2) & F.col("next").isNotNull())
    bare = F.regexp_replace("next", "[^\\p{L}\\p{N}_]", "")
    return pairs.select("doc_id", "page_index", "block_no", F.rtrim(F.col("last"), F.lit("-")).alias("fragment1"), F.col("next").alias("fragment2"), F.concat(F.rtrim(F.col("last"), F.lit("-")), bare).alias("joined"))


def judge_breaks(candidates: DataFrame, lex: DataFrame, limits: tuple[int, int] | None = (3, 25)) -> DataFrame:
    """candidates with confidence, should_join and reason. limits are the lengths of a joined word, None for any (legacy)."""
    c = candidates.withColumn("word", F.lower("joined"))
    verdict = judge(c, lex).select("word", "valid", F.col("confidence").alias("_c"))
    out = c.join(verdict, "word")
    fits = F.lit(True) if limits is None else F.length("joined").between(*limits)
    return out.select(
        *candidates.columns,
        F.when(fits, F.col("_c")).otherwise(0.0).alias("confidence"),
        (fits & F.col("valid")).alias("should_join"),
        F.when(~fits, "length").when(F.col("valid"), "word").otherwise("no word").alias("reason"),
    )


def apply_breaks(texts: DataFrame, judged: DataFrame, everywhere: bool = False) -> DataFrame:
    """doc_id, text with the accepted pairs joined.

    By default only at line ends; `everywhere` also joins the same two fragments where a hyphen stands between them on one
    line, once any broken one is accepted. The text is cut at its candidates and put together again, so each is handled in place.
    """
    yes = judged.where("should_join").groupBy("doc_id").agg(F.collect_set(F.concat("fragment1", F.lit("-"), "fragment2")).alias("yes"))
    pattern = "([\\p{L}\\p{N}_]+)-[ \\t\\n\\r\\f]*([\\p{L}\\p{N}_]+)" if everywhere else BREAK
    both = texts.join(yes, "doc_id", "left").withColumn("yes", F.coalesce("yes", F.array().cast("array<string>")))
    one, two, whole = (F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in (1, 2, 0))
    parts = F.split("text", pattern, -1)
    middle = F.zip_with(F.arrays_zip(one.alias("a"), two.alias("b")), whole, lambda x, w: F.when(F.array_contains("yes", F.concat(x["a"], F.lit("-"), x["b"])), F.concat(x["a"], x["b"])).otherwise(w))
    built = F.array_join(F.zip_with(parts, middle, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit("")))), "")
    return both.select("doc_id", F.when(F.size("yes") == 0, F.col("text")).otherwise(built).alias("text"))


def learn(judged: DataFrame, lex: DataFrame, least: float = 0.6) -> DataFrame:
    """word, occurrences, confidence, contexts of joined words that aren't in the lexicon: counted first, so the order doesn't matter."""
    c = judged.where(F.col("should_join") & (F.col("confidence") >= least)).withColumn("word", F.lower("joined"))
    c = c.join(lex.select("word"), "word", "left_anti").where(tx.pattern_score(F.col("word")) >= 0.5)
    counts = c.groupBy("word").agg(
        F.count("*").alias("occurrences"), F.array_join(F.slice(F.array_sort(F.collect_set(F.concat("fragment1", F.lit("-+"), "fragment2"))), 1, MAX_CONTEXTS), ",").alias("contexts")
    )
    scored = counts.join(morphology(counts, lex), "word", "left").withColumn("m", F.coalesce("morphology", F.lit(0.0)))
    first = (tx.pattern_score(F.col("word")) + F.col("m")) / 2
    return scored.select("word", "occurrences", F.round(F.least(first + 0.1 * (F.col("occurrences") - 1), F.lit(1.0)), 6).alias("confidence"), "contexts")
