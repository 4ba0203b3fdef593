"""Fonts, heading, outline and contents candidates, sections, validators, document types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import structure as st
from quire.plans.registry import Tables, query

_BLOCKS = "(SELECT * FROM d_blocks WHERE trim(text) <> '')"

_SIZES = f"SELECT doc_id, list_sort(list(font_size)) AS s, count(*) AS n FROM {_BLOCKS} GROUP BY doc_id"


@query("font_stats", f'SELECT doc_id, s[1] AS "min", s[n] AS "max", round(list_sum(s) / n, 6) AS mean, s[n // 2 + 1] AS median, s[n // 4 + 1] AS p25, s[3 * n // 4 + 1] AS p75 FROM ({_SIZES})')
def font_stats(t: Tables) -> DataFrame:
    return st.font_statistics(t.blocks)


@query("body_font", f"SELECT doc_id, arg_min(size, (-n, f)) AS size FROM (SELECT doc_id, round_even(font_size * 2, 0) / 2 AS size, count(*) AS n, min(page_index * 8 + block_no) AS f FROM {_BLOCKS} GROUP BY ALL) GROUP BY doc_id")
def body_font(t: Tables) -> DataFrame:
    return st.body_font(t.blocks)


@query("weighted_body_font", f"SELECT doc_id, arg_min(size, (-n, size)) AS size FROM (SELECT doc_id, round(font_size, 1) AS size, sum(length(text)) AS n FROM {_BLOCKS} GROUP BY ALL) GROUP BY doc_id")
def weighted_body_font(t: Tables) -> DataFrame:
    return st.weighted_body_font(t.blocks)


def _halves(t: Tables) -> DataFrame:
    """Every line of over 20 characters as two blocks side by side, some too far apart to be merged; shorter ones as one."""
    cut = F.when(F.length("text") > 20, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    b = t.blocks.select("*", F.explode(cut).alias("half"))
    first, middle = F.col("half") == 1, F.col("x0") + 100.0
    gap = F.when(F.length("text") > 60, 5.0).otherwise(25.0)
    return b.select(
        "doc_id", "page_index", (F.col("block_no") * 2 + F.col("half")).alias("block_no"), F.when(first, F.substring("text", 1, 20)).otherwise(F.expr("substring(text, 21)")).alias("text"),
        F.when(first, F.col("x0")).otherwise(middle + gap).alias("x0"), "y0", F.when(first, middle).otherwise(F.greatest(F.col("x1"), middle + gap + 1)).alias("x1"), "y1", "font_name", "font_size", "flags",
    )


@query("merged_blocks", """SELECT doc_id, page_index, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_no, half) - 1)::INT AS block_no, text, x0, x1, y0 FROM (
    SELECT doc_id, page_index, block_no, 1 AS half, CASE WHEN length(text) > 60 THEN substring(text, 1, 20) || ' ' || substring(text, 21) ELSE substring(text, 1, 20) END AS text, x0,
        CASE WHEN length(text) > 60 THEN greatest(x1, x0 + 106) ELSE x0 + 100 END AS x1, y0 FROM d_blocks
    UNION ALL SELECT doc_id, page_index, block_no, 2, substring(text, 21), x0 + 125, greatest(x1, x0 + 126), y0 FROM d_blocks WHERE length(text) BETWEEN 21 AND 60)""")
def merged_blocks(t: Tables) -> DataFrame:
    return st.merge_blocks(_halves(t)).select("doc_id", "page_index", "block_no", "text", "x0", "x1", "y0")


_HEADS = f"""SELECT b.doc_id, page_index, block_no, trim(b.text) AS title, font_size, med, coalesce(nullif(mad, 0), 1.0) AS mad, n, (flags & 16) <> 0 AS bold
    FROM {_BLOCKS} b JOIN (SELECT doc_id, any_value(med) AS med, median(abs(font_size - med)) AS mad, count(*) AS n FROM (SELECT doc_id, font_size, median(font_size) OVER (PARTITION BY doc_id) AS med FROM {_BLOCKS}) GROUP BY doc_id) m USING (doc_id)"""
_SCORE = f"""SELECT *, round(least(1.0, CASE WHEN (font_size - med) / (CASE WHEN n < 2 THEN 1.0 ELSE mad END) > 1.5 THEN least(0.4, (font_size - med) / (CASE WHEN n < 2 THEN 1.0 ELSE mad END) / 5) ELSE 0 END
    + CASE WHEN bold THEN 0.3 ELSE 0 END + CASE WHEN length(title) < 100 THEN 0.15 ELSE 0 END
    + CASE WHEN regexp_matches(title, '\\p{{Lu}}') AND NOT regexp_matches(title, '\\p{{Ll}}') AND length(title) > 3 THEN 0.2 ELSE 0 END
    + CASE WHEN regexp_matches(title, '\\p{{Lu}}') AND NOT regexp_matches(title, '(^|[^\\p{{Lu}}\\p{{Ll}}])\\p{{Ll}}') AND NOT regexp_matches(title, '[\\p{{Lu}}\\p{{Ll}}]\\p{{Lu}}')
        AND len(list_filter(regexp_split_to_array(title, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) >= 2 THEN 0.1 ELSE 0 END), 6) AS score,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_no) - 1 AS seq FROM ({_HEADS})"""
_HEADINGS = f"""SELECT h.doc_id, 'headings' AS source, h.seq::INT AS seq, p.start, h.title,
    CASE WHEN larger IS NULL THEN 2 WHEN h.font_size > h.med THEN least(list_position(larger, h.font_size), 4) ELSE 3 END::INT AS level, round(least(0.8, 0.5 + (score - 0.5) * 0.8), 6) AS confidence, h.page_index
    FROM ({_SCORE}) h JOIN p_spans p USING (doc_id, page_index)
    LEFT JOIN (SELECT doc_id, list(DISTINCT font_size ORDER BY font_size DESC) AS larger FROM ({_HEADS}) WHERE font_size > med GROUP BY doc_id) l ON l.doc_id = h.doc_id WHERE score >= 0.5"""


@query("heading_candidates", _HEADINGS)
def heading_candidates(t: Tables) -> DataFrame:
    return st.heading_candidates(t.blocks, t.page_spans)


_OUTLINED = "SELECT o.doc_id, 'outline' AS source, o.seq, p.start, trim(o.title) AS title, o.level::INT AS level, 0.95::DOUBLE AS confidence, o.page_index FROM d_outline o JOIN p_spans p USING (doc_id, page_index)"


@query("outline_candidates", _OUTLINED)
def outline_candidates(t: Tables) -> DataFrame:
    return st.outline_candidates(t.outline, t.page_spans)


_LIKELY = """SELECT doc_id, page_index, text, round(least(1.0, CASE WHEN lower(text) LIKE '%table of contents%' THEN 0.5 WHEN lower(text) LIKE '%contents%' THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '\\.{3,}') THEN 0.3 ELSE 0 END
    + CASE WHEN len(list_filter(string_split(trim(text), chr(10)), lambda x: regexp_matches(x, '[0-9]+[ \\t]*$'))) / len(string_split(trim(text), chr(10))) > 0.3 THEN 0.3 ELSE 0 END), 6)::DOUBLE AS likelihood
    FROM (SELECT doc_id, page_index, text FROM d_contents UNION ALL SELECT doc_id, page_index, text FROM d_pages WHERE text <> '') WHERE page_index < 20"""


def _with_contents(t: Tables) -> DataFrame:
    return t.contents.unionByName(t.pages.select("doc_id", "page_index", "text"))


@query("toc_pages", f"SELECT doc_id, page_index, likelihood FROM ({_LIKELY}) WHERE likelihood > 0.5")
def toc_pages(t: Tables) -> DataFrame:
    return st.contents_pages(_with_contents(t)).select("doc_id", "page_index", "likelihood")


_ENTRIES = f"""SELECT doc_id, line_no, title, page_ref, CASE WHEN regexp_matches(lower(title), '^(chapter|part)[ \\t]+') THEN 1 WHEN regexp_matches(title, '^[0-9]+\\.[0-9]+') THEN 2 ELSE 1 END::INT AS level FROM (
    SELECT doc_id, line_no, dots, trim(regexp_extract(line, CASE WHEN dots THEN '^(.+?)[ \\t]*\\.{{3,}}[ \\t]*([0-9]+)[ \\t]*$' ELSE '^(.+?)[ \\t]{{2,}}([0-9]+)[ \\t]*$' END, 1)) AS title,
      regexp_extract(line, CASE WHEN dots THEN '^(.+?)[ \\t]*\\.{{3,}}[ \\t]*([0-9]+)[ \\t]*$' ELSE '^(.+?)[ \\t]{{2,}}([0-9]+)[ \\t]*$' END, 2) AS page_ref FROM (
    SELECT doc_id, line_no, trim(raw) AS line, regexp_matches(trim(raw), '^(.+?)[ \\t]*\\.{{3,}}[ \\t]*([0-9]+)[ \\t]*$') AS dots FROM (
    SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS raw FROM (SELECT doc_id, string_split(trim(text), chr(10)) AS ls FROM ({_LIKELY}) WHERE likelihood > 0.5)) WHERE length(trim(raw)) >= 5))
    WHERE page_ref <> '' AND (dots OR length(title) > 3)"""


@query("toc_entries", f"SELECT doc_id, line_no::INT AS line_no, title, page_ref, level FROM ({_ENTRIES})")
def toc_entries(t: Tables) -> DataFrame:
    return st.contents_entries(st.contents_pages(_with_contents(t))).select("doc_id", "line_no", "title", "page_ref", "level")


_RESOLVED = f"""SELECT e.doc_id, e.line_no::INT AS seq, e.title, e.level, coalesce(CASE WHEN try_cast(page_ref AS BIGINT) BETWEEN 1 AND c.n THEN try_cast(page_ref AS BIGINT) - 1 END, l.page_index) AS page_index
    FROM ({_ENTRIES}) e JOIN (SELECT doc_id, count(*) AS n FROM d_pages GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT doc_id, label, min(page_index) AS page_index FROM d_pages GROUP BY ALL) l ON l.doc_id = e.doc_id AND l.label = e.page_ref"""


@query("page_references", f"SELECT doc_id, seq, title, page_index FROM ({_RESOLVED})")
def page_references(t: Tables) -> DataFrame:
    found = st.resolve_page(st.contents_entries(st.contents_pages(_with_contents(t))), t.page_spans)
    return found.select("doc_id", F.col("line_no").alias("seq"), "title", F.col("page").alias("page_index"))


@query("toc_candidates", f"SELECT r.doc_id, 'contents' AS source, seq, p.start, title, level, 0.7::DOUBLE AS confidence, page_index FROM ({_RESOLVED}) r JOIN p_spans p USING (doc_id, page_index)")
def toc_candidates(t: Tables) -> DataFrame:
    return st.contents_candidates(_with_contents(t), t.page_spans)


def _cascade(t: Tables) -> DataFrame:
    found = st.cascade(outline_candidates(t), heading_candidates(t).select(st.CANDIDATE))
    return st.sections(found, t.texts)


_SECTIONS = f"""SELECT c.doc_id, row_number() OVER w - 1 AS seq, c.start, coalesce(lead(c.start) OVER w, length(t.text)) AS "end", title, level, confidence, source FROM (
    SELECT * FROM ({_OUTLINED}) UNION ALL SELECT * FROM ({_HEADINGS}) WHERE doc_id NOT IN (SELECT doc_id FROM d_outline)) c JOIN d_text t USING (doc_id) WHERE confidence >= 0.5 WINDOW w AS (PARTITION BY c.doc_id ORDER BY c.start, c.seq)"""


@query("sections_cascade", f'SELECT doc_id, seq::INT AS seq, start, "end", title, level, confidence, source FROM ({_SECTIONS})')
def sections_cascade(t: Tables) -> DataFrame:
    return _cascade(t)


@query("sections_enriched")
def sections_enriched(t: Tables) -> DataFrame:
    found = st.cascade(outline_candidates(t), heading_candidates(t).select(st.CANDIDATE))
    return st.sections(st.enrich_titles(found, toc_candidates(t)), t.texts)


def _loose(t: Tables) -> DataFrame:
    """Sections that break the rules: each runs on, levels skip, some titles are digits or empty."""
    title = F.when(F.col("seq") % 3 == 0, F.lit("12")).when(F.col("seq") % 3 == 1, F.rpad("title", 220, "x")).otherwise(F.col("title"))
    return _cascade(t).select("doc_id", "seq", "start", (F.col("end") + 10).alias("end"), title.alias("title"), (F.col("seq") % 4 + 1).alias("level"), "confidence", "source")


_LOOSE = f"""SELECT doc_id, seq::INT AS seq, start, "end" + 10 AS "end", CASE WHEN seq % 3 = 0 THEN '12' WHEN seq % 3 = 1 THEN rpad(title, 220, 'x') ELSE title END AS title, seq % 4 + 1 AS level, confidence, source FROM ({_SECTIONS})"""
_OVERLAP = f"""SELECT doc_id, 'overlap' AS type, 'warning' AS severity, seq, title FROM (SELECT *, lead(start) OVER (PARTITION BY doc_id, level ORDER BY start, seq) AS n FROM ({_LOOSE})) WHERE "end" > n"""
_HIERARCHY = f"SELECT doc_id, 'hierarchy_skip' AS type, 'info' AS severity, seq, title FROM (SELECT *, lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY start, seq) AS b FROM ({_LOOSE})) WHERE level > b + 1"
_CONTENT = f"""SELECT doc_id, 'short_section' AS type, 'info' AS severity, seq, title FROM ({_LOOSE}) WHERE "end" - start < 100"""
_TITLE = f"""SELECT doc_id, CASE WHEN length(t) < 3 THEN 'short_title' WHEN length(t) > 200 THEN 'long_title' ELSE 'numeric_title' END AS type, CASE WHEN length(t) > 200 THEN 'warning' ELSE 'info' END AS severity, seq,
    CASE WHEN length(t) > 200 THEN substring(t, 1, 50) || '...' ELSE t END AS title FROM (SELECT *, trim(title) AS t FROM ({_LOOSE})) WHERE length(t) < 3 OR length(t) > 200 OR regexp_matches(t, '^[0-9]+$')"""
_ALL = f"SELECT * FROM ({_OVERLAP}) UNION ALL SELECT * FROM ({_HIERARCHY}) UNION ALL SELECT * FROM ({_CONTENT}) UNION ALL SELECT * FROM ({_TITLE})"


@query("validate_overlap", _OVERLAP)
def validate_overlap(t: Tables) -> DataFrame:
    return st.overlap_issues(_loose(t))


@query("validate_hierarchy", _HIERARCHY)
def validate_hierarchy(t: Tables) -> DataFrame:
    return st.hierarchy_issues(_loose(t))


@query("validate_min_content", _CONTENT)
def validate_min_content(t: Tables) -> DataFrame:
    return st.content_issues(_loose(t))


@query("validate_title", _TITLE)
def validate_title(t: Tables) -> DataFrame:
    return st.title_issues(_loose(t))


@query("structure_confidence", f"""SELECT doc_id, round(greatest(0.0, CASE WHEN outlined THEN least(1.0, base + 0.05) ELSE base END - coalesce(fine, 0)), 6)::DOUBLE AS confidence
    FROM (SELECT doc_id, sum(round(confidence * 1e6)::BIGINT)::BIGINT / count(*) / 1e6 AS base, bool_or(source = 'outline') AS outlined FROM ({_LOOSE}) GROUP BY doc_id) LEFT JOIN (
    SELECT doc_id, sum(CASE WHEN severity = 'warning' THEN 5 ELSE 2 END)::BIGINT / 100 AS fine FROM ({_ALL}) GROUP BY doc_id) USING (doc_id)""")
def structure_confidence(t: Tables) -> DataFrame:
    loose = _loose(t)
    return st.structure_confidence(loose, st.validate(loose))


_IND = """SELECT doc_id, count(*) AS n_pages, bool_or(page_index < 20 AND (lower(text) LIKE '%contents%' OR lower(text) LIKE '%inhalt%' OR lower(text) LIKE '%sommaire%')) AS has_contents,
    bool_or(page_index < 20 AND lower(text) LIKE '%abstract%') AS has_abstract, bool_or(page_index < 20 AND regexp_matches(text, '[0-9]+\\.[0-9]+')) AS has_numbers, doc_id IN (SELECT doc_id FROM d_outline) AS has_outline
    FROM (SELECT doc_id, page_index, text FROM d_pages UNION ALL SELECT doc_id, page_index, text FROM d_contents) GROUP BY doc_id"""
_TYPES = f"""SELECT *, CASE WHEN greatest(book, article, essay, report) < 0.3 THEN 'generic' WHEN book = greatest(book, article, essay, report) THEN 'book' WHEN article = greatest(book, article, essay, report) THEN 'article'
    WHEN essay = greatest(book, article, essay, report) THEN 'essay' ELSE 'report' END AS type FROM (SELECT *,
    round((CASE WHEN n_pages > 100 THEN 0.4 ELSE 0 END + CASE WHEN has_contents THEN 0.3 ELSE 0 END + CASE WHEN has_outline THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS book,
    round((CASE WHEN n_pages < 30 THEN 0.3 ELSE 0 END + CASE WHEN has_abstract THEN 0.4 ELSE 0 END)::DOUBLE, 6) AS article, (CASE WHEN n_pages < 60 THEN 0.2 ELSE 0 END)::DOUBLE AS essay,
    round((CASE WHEN n_pages >= 30 AND n_pages < 60 THEN 0.2 ELSE 0 END + CASE WHEN has_contents THEN 0.2 ELSE 0 END + CASE WHEN has_outline THEN 0.1 ELSE 0 END + CASE WHEN has_numbers THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS report FROM ({_IND}))"""


def _indicators(t: Tables) -> DataFrame:
    return st.indicators(_with_contents(t), t.outline)


@query("doc_indicators", _IND)
def doc_indicators(t: Tables) -> DataFrame:
    return _indicators(t)


@query("doc_type", _TYPES)
def doc_type(t: Tables) -> DataFrame:
    return st.type_scores(_indicators(t))


@query("doc_type_builder", f"SELECT doc_id, CASE WHEN has_outline THEN 'book' WHEN n_pages < 30 THEN 'article' ELSE 'generic' END AS type FROM ({_IND})")
def doc_type_builder(t: Tables) -> DataFrame:
    return st.builder_type(_indicators(t))


@query("doc_profile", f"""SELECT doc_id, type, type IN ('book', 'report') AS use_contents, CASE WHEN type IN ('article', 'essay') THEN 0.4 ELSE 0.5 END::DOUBLE AS least,
    CASE type WHEN 'book' THEN 'overlap,hierarchy,title_quality' WHEN 'essay' THEN 'overlap,min_content' WHEN 'report' THEN 'overlap,hierarchy' ELSE 'overlap' END AS validators FROM ({_TYPES})""")
def doc_profile(t: Tables) -> DataFrame:
    return st.with_profile(st.type_scores(_indicators(t)).select("doc_id", "type"))
