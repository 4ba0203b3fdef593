"""Lexicon, membership, morphology, detection, line breaks, learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import vocabulary
from quire.operators import words
from quire.plans.registry import Tables, query
from quire.runtime import written


def _lex(t: Tables) -> DataFrame:
    return t.lexicon


def _tokens(t: Tables) -> DataFrame:
    return words.tokens(t.degraded)


_PATTERN = f"""CASE WHEN NOT regexp_matches(word, '^[a-zA-ZäöüÄÖÜßàâçéèêëîïôùû]+$') THEN 0.0 WHEN length(word) < 2 OR length(word) > 30 THEN 0.0
    WHEN regexp_matches(lower(word), '{tx.TRIPLES}') THEN 0.0 WHEN NOT regexp_matches(lower(word), '[aeiouäöü]') THEN 0.2 ELSE 0.7 END::DOUBLE"""
_SUFFIXES = ", ".join(f"({4 * k}, '{s}', {score})" for k, (s, score) in enumerate(vocabulary.SUFFIXES))
_PREFIXES = ", ".join(f"({1000 + k}, '{s}', {score})" for k, (s, score) in enumerate(vocabulary.PREFIXES))


def _morphology(of: str) -> str:
    return f"""SELECT word, arg_min(score, ord) AS morphology FROM (
        WITH w AS (SELECT DISTINCT word FROM ({of})), s AS (SELECT word, ord, suffix, score, left(word, (length(word) - length(suffix))::INT) AS base FROM w, (VALUES {_SUFFIXES}) v(ord, suffix, score) WHERE suffix(word, suffix) AND length(word) > length(suffix) + 3)
        SELECT word, ord, base, score::DOUBLE AS score FROM s
        UNION ALL SELECT word, ord + 1, left(base, (length(base) - 1)::INT), round(score * 0.9, 6)::DOUBLE FROM s WHERE suffix IN ('ing', 'ed')
        UNION ALL SELECT word, ord + 2, base || 'ize', score::DOUBLE FROM s WHERE suffix[1:2] IN ('iz', 'is') UNION ALL SELECT word, ord + 3, base || 'ise', score::DOUBLE FROM s WHERE suffix[1:2] IN ('iz', 'is')
        UNION ALL SELECT word, ord, substring(word, length(prefix) + 1), score::DOUBLE FROM w, (VALUES {_PREFIXES}) v(ord, prefix, score) WHERE starts_with(word, prefix) AND length(word) > length(prefix) + 3)
        WHERE base IN (SELECT word FROM d_lexicon) GROUP BY word"""


def _judge(of: str) -> str:
    return f"""SELECT *, known OR confidence >= 0.5 AS valid FROM (SELECT word, known, morphology, pattern, CASE WHEN known THEN 1.0 ELSE round(least(morphology + pattern * 0.3, 1.0), 6) END::DOUBLE AS confidence FROM (
        SELECT word, word IN (SELECT word FROM d_lexicon) AS known, coalesce(m.morphology, 0)::DOUBLE AS morphology, {_PATTERN} AS pattern FROM (SELECT DISTINCT word FROM ({of})) LEFT JOIN ({_morphology(of)}) m USING (word)))"""


_LONG = "SELECT word FROM d_tokens WHERE length(word) >= 2"
_SCHOLARLY = ", ".join(f"'{w}'" for w in sorted(vocabulary.DETECTION))


def _detect(mode: str) -> str:
    fine = "known" if mode == "new" else "valid"
    return f"""SELECT doc_id, pos, token, word, status, CASE WHEN status = 'error' THEN round(1 - c, 6) END AS confidence FROM (
        SELECT t.*, v.confidence AS c, CASE WHEN length(word) < 2 THEN 'short' WHEN word IN ({_SCHOLARLY}) THEN 'scholarly' WHEN {fine} THEN 'valid' ELSE 'error' END AS status FROM d_tokens t LEFT JOIN ({_judge(_LONG)}) v USING (word))"""


@query("lexicon", "SELECT word, doc_freq, freq, round(zipf, 6) AS zipf FROM d_lexicon")
def lexicon(t: Tables) -> DataFrame:
    return _lex(t).withColumn("zipf", F.round("zipf", 6))


@query("tokens", "SELECT doc_id, pos::INT AS pos, token, word FROM d_tokens")
def tokens(t: Tables) -> DataFrame:
    return _tokens(t)


@query("known_words", "SELECT word, word IN (SELECT word FROM d_lexicon) AS known FROM (SELECT DISTINCT word FROM d_tokens)")
def known_words(t: Tables) -> DataFrame:
    return words.known(_tokens(t).select("word").distinct(), _lex(t))


@query("pattern_score", f"SELECT word, {_PATTERN} AS pattern FROM (SELECT DISTINCT word FROM d_tokens)")
def pattern_score(t: Tables) -> DataFrame:
    return _tokens(t).select("word").distinct().withColumn("pattern", tx.pattern_score(F.col("word")))


@query("morphology_score", _morphology(_LONG))
def morphology_score(t: Tables) -> DataFrame:
    return words.morphology(_tokens(t).where("length(word) >= 2"), _lex(t))


@query("word_validity", _judge(_LONG))
def word_validity(t: Tables) -> DataFrame:
    return words.judge(words.cleaned(t.degraded).where("length(word) >= 2"), _lex(t))


@query("legacy_words", "SELECT doc_id, pos::INT AS pos, regexp_replace(lower(token), '[^\\p{L}\\p{N}_]', '', 'g') AS word FROM d_tokens")
def legacy_words(t: Tables) -> DataFrame:
    return _tokens(t).select("doc_id", "pos", tx.bare_word(F.col("token")).alias("word"))


def _errors(t: Tables, mode: str) -> DataFrame:
    return words.errors(t.degraded, _lex(t), mode)


@query("ocr_errors_new", f"SELECT doc_id, pos::INT AS pos, token, word, confidence FROM ({_detect('new')}) WHERE status = 'error'")
def ocr_errors_new(t: Tables) -> DataFrame:
    return _errors(t, "new")


@query("ocr_errors_legacy", f"SELECT doc_id, pos::INT AS pos, token, word, confidence FROM ({_detect('legacy')}) WHERE status = 'error'")
def ocr_errors_legacy(t: Tables) -> DataFrame:
    return _errors(t, "legacy")


_STATS = f"""SELECT doc_id, count(*) AS words_checked, count(*) FILTER (WHERE status = 'short') AS skipped_short, count(*) FILTER (WHERE status = 'scholarly') AS skipped_scholarly,
    count(*) FILTER (WHERE status = 'valid') AS skipped_valid, count(*) FILTER (WHERE status = 'error') AS errors FROM ({_detect('new')}) GROUP BY doc_id"""


@query("detect_stats", _STATS)
def detect_stats(t: Tables) -> DataFrame:
    return words.text_statistics(t.degraded, _lex(t))


@query("quality_level", f"""SELECT doc_id, round(rate, 6) AS error_rate, CASE WHEN errors > 0 AND rate > 0.05 THEN 'bad' WHEN errors > 0 AND rate > 0.02 THEN 'marginal' ELSE 'good' END AS level,
    CASE WHEN errors = 0 THEN 0.95 WHEN rate > 0.05 THEN 0.5 WHEN rate > 0.02 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT *, errors / greatest(words_checked, 1) AS rate FROM ({_STATS}))""")
def quality_level(t: Tables) -> DataFrame:
    return words.quality_level(detect_stats(t))


@query("needs_reocr", f"SELECT doc_id, string_agg(DISTINCT (pos // 100)::VARCHAR, ',' ORDER BY (pos // 100)::VARCHAR) AS pages FROM ({_detect('new')}) WHERE status = 'error' GROUP BY doc_id")
def needs_reocr(t: Tables) -> DataFrame:
    doubtful = words.tokens(t.degraded).where((F.length("word") >= words.LEAST_WORD) & ~words.scholarly(F.col("word")))
    found = doubtful.join(words.listed(_lex(t).select("word")), "word", "left_anti").select("doc_id", F.floor(F.col("pos") / 100).cast("string").alias("page"))
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"))


_BREAK = "([\\p{L}\\p{N}_]+)-[ \\t\\r\\f]*\\n[ \\t\\n\\r\\f]*([\\p{L}\\p{N}_]+)"
_BREAKS = f"""SELECT doc_id, generate_subscripts(a, 1) - 1 AS k, unnest(a) AS fragment1, unnest(b) AS fragment2, unnest(a) || unnest(b) AS joined FROM (
    SELECT doc_id, regexp_extract_all(text, '{_BREAK}', 1) AS a, regexp_extract_all(text, '{_BREAK}', 2) AS b FROM d_degraded)"""


def _judged(of: str, limits: bool) -> str:
    fits = "length(joined) BETWEEN 3 AND 25" if limits else "true"
    return f"""SELECT c.*, CASE WHEN {fits} THEN v.confidence ELSE 0.0 END AS confidence, {fits} AND v.valid AS should_join, CASE WHEN NOT ({fits}) THEN 'length' WHEN v.valid THEN 'word' ELSE 'no word' END AS reason
        FROM ({of}) c JOIN ({_judge(f"SELECT lower(joined) AS word FROM ({of})")}) v ON v.word = lower(c.joined)"""


def _breaks(t: Tables, limits: bool = True) -> DataFrame:
    # a small table that is read several times, made from all texts
    found = written(words.break_candidates(t.degraded), "breaks")
    return words.judge_breaks(found, _lex(t), (3, 25) if limits else None)


@query("linebreak_candidates_text", f"SELECT doc_id, k::INT AS k, fragment1, fragment2, joined, confidence, should_join, reason FROM ({_judged(_BREAKS, True)})")
def linebreak_candidates_text(t: Tables) -> DataFrame:
    return _breaks(t)


@query("linebreak_candidates_legacy", f"SELECT doc_id, k::INT AS k, fragment1, fragment2, joined, confidence, should_join, reason FROM ({_judged(_BREAKS, False)})")
def linebreak_candidates_legacy(t: Tables) -> DataFrame:
    return _breaks(t, limits=False)


_BLOCKED = """SELECT doc_id, page_index, block_no, rtrim(last, '-') AS fragment1, next AS fragment2, rtrim(last, '-') || regexp_replace(next, '[^\\p{L}\\p{N}_]', '', 'g') AS joined FROM (
    SELECT doc_id, line_no // 8 AS page_index, line_no % 8 AS block_no, w[-1] AS last, lead(w[1]) OVER (PARTITION BY doc_id, line_no // 8 ORDER BY line_no) AS next FROM (
    SELECT doc_id, line_no, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM (
    SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d_degraded))) WHERE len(w) > 0)
    WHERE suffix(last, '-') AND length(last) > 2 AND next IS NOT NULL"""


@query("linebreak_candidates_block", f"SELECT doc_id, page_index::BIGINT AS page_index, block_no::INT AS block_no, fragment1, fragment2, joined, confidence, should_join, reason FROM ({_judged(_BLOCKED, True)})")
def linebreak_candidates_block(t: Tables) -> DataFrame:
    from quire.sources import layout

    return words.judge_breaks(words.block_break_candidates(layout.blocks(t.degraded)), _lex(t))


@query("linebreak_apply", f"""SELECT d.doc_id, CASE WHEN yes IS NULL THEN text ELSE list_aggregate(list_transform(parts, lambda p, i: p || coalesce(CASE WHEN list_contains(yes, a[i] || '-' || b[i]) THEN a[i] || b[i] ELSE w[i] END, '')), 'string_agg', '') END AS text FROM (
    SELECT doc_id, text, regexp_split_to_array(text, '{_BREAK}') AS parts, regexp_extract_all(text, '{_BREAK}', 1) AS a, regexp_extract_all(text, '{_BREAK}', 2) AS b, regexp_extract_all(text, '{_BREAK}', 0) AS w FROM d_degraded) d
    LEFT JOIN (SELECT doc_id, list(DISTINCT fragment1 || '-' || fragment2) AS yes FROM ({_judged(_BREAKS, True)}) WHERE should_join GROUP BY doc_id) y USING (doc_id)""")
def linebreak_apply(t: Tables) -> DataFrame:
    return words.apply_breaks(t.degraded, _breaks(t))


@query("learned_lexicon", f"""SELECT word, n AS occurrences, round(least((pattern + coalesce(m.morphology, 0)) / 2 + 0.1 * (n - 1), 1.0), 6)::DOUBLE AS confidence, contexts FROM (
    SELECT word, count(*) AS n, array_to_string(list_sort(list(DISTINCT fragment1 || '-+' || fragment2))[1:5], ',') AS contexts, {_PATTERN} AS pattern FROM (SELECT *, lower(joined) AS word FROM ({_judged(_BREAKS, True)}) WHERE should_join AND confidence >= 0.6)
    WHERE word NOT IN (SELECT word FROM d_lexicon) GROUP BY word) LEFT JOIN ({_morphology(f"SELECT lower(joined) AS word FROM ({_BREAKS})")}) m USING (word) WHERE pattern >= 0.5""")
def learned_lexicon(t: Tables) -> DataFrame:
    return words.learn(_breaks(t), _lex(t))
