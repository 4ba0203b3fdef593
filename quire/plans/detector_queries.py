"""Detectors over blocks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import vocabulary
from quire.operators import detectors as de
from quire.operators import structure as st
from quire.operators import words
from quire.plans import survey_queries as sv
from quire.plans.registry import Tables, query

_BLOCKS = "(SELECT * FROM d_blocks WHERE trim(text) <> '')"


@query("metadata", "SELECT doc_id, nullif(trim(source), '') AS title, nullif(trim(lang), '') AS author, coalesce(nullif(trim(lang), ''), '') AS authors, 'en' AS language, p.page_count FROM documents JOIN (SELECT doc_id, count(*) AS page_count FROM d_pages GROUP BY doc_id) p USING (doc_id)")
def metadata(t: Tables) -> DataFrame:
    return de.metadata(t.docs.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("author")), t.pages)


@query("font_census", f"""SELECT doc_id, font_name, font_size, flags, n, CASE WHEN font_size > b + 1 THEN 'larger' WHEN font_size = b THEN 'body' ELSE 'smaller' END AS role FROM (
    SELECT *, first_value(font_size) OVER (PARTITION BY doc_id ORDER BY n DESC, font_name, font_size, flags) AS b FROM (SELECT doc_id, font_name, font_size, flags, count(*) AS n FROM {_BLOCKS} GROUP BY ALL))""")
def font_census(t: Tables) -> DataFrame:
    return de.font_census(t.blocks)


@query("layout_columns", f"""SELECT *, n_left > 2 AND n_right > 2 AND abs(n_left - n_right) < 0.5 * greatest(n_left, n_right) AS two_columns FROM (
    SELECT doc_id, page_index, count(*) FILTER (WHERE (x0 + x1) / 2 < 306) AS n_left, count(*) FILTER (WHERE (x0 + x1) / 2 >= 306) AS n_right FROM {_BLOCKS} GROUP BY ALL)""")
def layout_columns(t: Tables) -> DataFrame:
    return de.columns(t.blocks)


@query("foot_notes", """SELECT doc_id, page_index, block_no, text FROM (SELECT *, max(y1) OVER w AS h, max(font_size) OVER w AS s FROM d_blocks WINDOW w AS (PARTITION BY doc_id, page_index))
    WHERE y0 > 0.75 * h AND (font_size < 0.85 * s OR regexp_matches(text, '^[ \\t]*([0-9]{1,3}|[*†‡¹²³])[ .)]'))""")
def foot_notes(t: Tables) -> DataFrame:
    return de.foot_notes(t.blocks)


@query("block_quotes", "SELECT doc_id, page_index, block_no, floor((x0 - 72) / 36)::INT AS depth FROM d_blocks WHERE x0 > 100 AND length(text) > 50")
def block_quotes(t: Tables) -> DataFrame:
    return de.block_quotes(t.blocks)


@query("heading_votes", f"""SELECT doc_id, page_index, block_no, score FROM (SELECT b.doc_id, page_index, block_no, round((CASE WHEN font_size > size * 1.2 THEN 0.4 ELSE 0 END + CASE WHEN (flags & 16) <> 0 THEN 0.3 ELSE 0 END
    + CASE WHEN block_no = 0 THEN 0.2 ELSE 0 END + CASE WHEN length(text) < 80 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score FROM {_BLOCKS} b JOIN (
    SELECT doc_id, arg_min(size, (-n, size)) AS size FROM (SELECT doc_id, round(font_size, 1) AS size, sum(length(text)) AS n FROM {_BLOCKS} GROUP BY ALL) GROUP BY doc_id) USING (doc_id)) WHERE score >= 0.5""")
def heading_votes(t: Tables) -> DataFrame:
    return de.heading_votes(t.blocks, st.weighted_body_font(t.blocks))


_LONG = "list_distinct(list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r\\f]+'), lambda w: length(w) > 2))"


@query("outline_matches", f"""SELECT doc_id, seq, line_no::INT AS line_no, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY line_no) AS n FROM (
    SELECT o.doc_id, o.seq, line_no, CASE WHEN t = x THEN 'exact' WHEN length(t) > 10 AND contains(x, t) THEN 'within' WHEN len(tw) > 0 AND len(list_intersect(tw, xw)) >= 0.8 * len(tw) THEN 'words' END AS kind FROM (
    SELECT o.doc_id, o.seq, l.line_no, lower(trim(title)) AS t, lower(trim(line)) AS x, {_LONG.format(c="lower(trim(title))")} AS tw, {_LONG.format(c="lower(trim(line))")} AS xw FROM d_outline o JOIN (
    SELECT doc_id, page_index, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, page_index, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:20] AS ls FROM d_pages)) l USING (doc_id, page_index)) o)
    WHERE kind IS NOT NULL) WHERE n = 1""")
def outline_matches(t: Tables) -> DataFrame:
    return de.outline_matches(t.outline, t.pages)


@query("page_error_rates", f"""SELECT *, round(n_unknown / n_words, 6) AS rate FROM (SELECT doc_id, page_index, count(*) AS n_words, count(DISTINCT word) FILTER (WHERE word NOT IN (SELECT word FROM d_lexicon)) AS n_unknown FROM (
    SELECT doc_id, page_index, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]{{3,}}')) AS word FROM ({sv._PAGES})) GROUP BY ALL) WHERE n_words >= 10""")
def page_error_rates(t: Tables) -> DataFrame:
    return de.error_rates(sv._pages(t), t.lexicon)


_MARKS = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in tx.MARKS.values())
_TRIAGE = f"""SELECT doc_id, page_index, CASE WHEN reason = 'marks' THEN 'REVIEW' ELSE 'SKIP' END AS action, reason FROM (SELECT doc_id, page_index, CASE WHEN n = 0 THEN 'blank' WHEN n < 10 THEN 'short' WHEN m = 0 THEN 'clean' ELSE 'marks' END AS reason FROM (
    SELECT doc_id, page_index, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n, {_MARKS} AS m FROM ({sv._PAGES})))"""


@query("page_triage", _TRIAGE)
def page_triage(t: Tables) -> DataFrame:
    return de.triage(sv._pages(t))


@query("triage_totals", f"SELECT *, round(100 * skipped / (skipped + reviewed), 6) AS saved FROM (SELECT doc_id, count(*) FILTER (WHERE action = 'SKIP') AS skipped, count(*) FILTER (WHERE action = 'REVIEW') AS reviewed FROM ({_TRIAGE}) GROUP BY doc_id)")
def triage_totals(t: Tables) -> DataFrame:
    return de.triage_totals(page_triage(t))


_TERMS = ", ".join(f"'{w}'" for w in sorted(vocabulary.CORRECTION))


@query("skip_reasons", f"""SELECT CASE WHEN length(word) < 4 THEN 'short' WHEN regexp_matches(word, '[0-9]') THEN 'number' WHEN word IN (SELECT word FROM d_lexicon) THEN 'known' WHEN word IN ({_TERMS}) THEN 'scholarly'
    WHEN regexp_matches(token, '\\p{{Lu}}') AND NOT regexp_matches(token, '\\p{{Ll}}') AND length(token) > 1 THEN 'capitals' WHEN regexp_matches(token, '^\\p{{Lu}}') THEN 'name'
    WHEN regexp_matches(word, '({"|".join(vocabulary.FOREIGN_ENDINGS)})$') OR (length(word) >= 6 AND contains(word, 'sch')) THEN 'foreign' ELSE 'candidate' END AS reason, count(*) AS n FROM d_tokens GROUP BY reason""")
def skip_reasons(t: Tables) -> DataFrame:
    return de.skip_reasons(words.tokens(t.degraded), t.lexicon)


_PAIR = """'["'']?([\\p{L}\\p{N}_''-]+)["'']?[ \\t]*(?:→|->)[ \\t]*["'']?([\\p{L}\\p{N}_''-]+)'"""


@query("error_pairs", f"""SELECT * FROM (SELECT doc_id, pos::INT AS pos, regexp_extract(e, {_PAIR}, 1) AS wrong, regexp_extract(e, {_PAIR}, 2) AS "right" FROM (
    SELECT doc_id, pos, 'seen: ' || token || ' → ' || word AS e FROM d_tokens)) WHERE wrong <> ''""")
def error_pairs(t: Tables) -> DataFrame:
    found = de.error_pairs(words.tokens(t.degraded), F.concat(F.lit("seen: "), "token", F.lit(" → "), "word"))
    return found.select("doc_id", "pos", "wrong", "right")


def _both(t: Tables) -> DataFrame:
    """Whole texts and their damaged ones."""
    return t.docs.select("doc_id", F.col("text").alias("x")).join(t.degraded.select("doc_id", F.col("text").alias("y")), "doc_id")


@query("word_error_rate")
def word_error_rate(t: Tables) -> DataFrame:
    from quire.runtime import prepare

    prepare(t.spark)
    return _both(t).select("doc_id", F.round(de.word_error_rate("x", "y"), 6).alias("rate"))


@query("character_error_rate")
def character_error_rate(t: Tables) -> DataFrame:
    from quire.runtime import prepare

    prepare(t.spark)
    return _both(t).select("doc_id", F.round(de.character_error_rate("x", "y"), 6).alias("rate"))


@query("aligned_error_rate", """SELECT doc_id, CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 0.0 ELSE 1.0 END ELSE round((len(list_filter(list_zip(x[1:least(n, m)], y[1:least(n, m)]), lambda p: p[1] <> p[2])) + abs(n - m)) / n, 6) END::DOUBLE AS rate FROM (
    SELECT doc_id, string_split(a.text, '') AS x, string_split(b.text, '') AS y, length(a.text) AS n, length(b.text) AS m FROM documents a JOIN d_degraded b USING (doc_id))""")
def aligned_error_rate(t: Tables) -> DataFrame:
    return _both(t).select("doc_id", tx.aligned_error_rate(F.col("x"), F.col("y")).alias("rate"))
