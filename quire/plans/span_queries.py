"""Layout, spans, range lookups and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunks, spans
from quire.plans.registry import Tables, query

_RANGES = "SELECT doc_id, page_index, start + 100 AS from_pos, \"end\" + 100 AS to_pos FROM p_spans"


def _ranges(t: Tables) -> DataFrame:
    return t.page_spans.select("doc_id", "page_index", (F.col("start") + 100).alias("from_pos"), (F.col("end") + 100).alias("to_pos"))


@query("layout_lines", "SELECT doc_id, line_no::INT AS line_no, text FROM d_lines")
def layout_lines(t: Tables) -> DataFrame:
    return t.lines


@query("layout_pages", "SELECT doc_id, page_index, label, text FROM d_pages")
def layout_pages(t: Tables) -> DataFrame:
    return t.pages


@query("layout_blocks", "SELECT *, x1 - x0 AS width, y1 - y0 AS height, (flags & 16) <> 0 AS is_bold, (flags & 2) <> 0 AS is_italic FROM d_blocks WHERE trim(text) <> ''")
def layout_blocks(t: Tables) -> DataFrame:
    bit = lambda n: F.col("flags").bitwiseAND(n) != 0
    return t.blocks.where(F.trim("text") != "").select("*", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), bit(16).alias("is_bold"), bit(2).alias("is_italic"))


@query("layout_outline", "SELECT doc_id, seq, level::INT AS level, trim(title) AS title, greatest(0, page_index) AS page_index FROM d_outline")
def layout_outline(t: Tables) -> DataFrame:
    return t.outline.select("doc_id", "seq", "level", F.trim("title").alias("title"), F.greatest(F.lit(0).cast("long"), "page_index").alias("page_index"))


@query("whole_text", "SELECT doc_id, text FROM d_text")
def whole_text(t: Tables) -> DataFrame:
    return t.texts


@query("first_pages_text", "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_index) FILTER (WHERE text <> '') AS text FROM d_pages WHERE page_index < 20 GROUP BY doc_id HAVING count(*) FILTER (WHERE text <> '') > 0")
def first_pages_text(t: Tables) -> DataFrame:
    return spans.whole_text(t.pages, first=20).where("text <> ''")


@query("page_positions", 'SELECT doc_id, page_index, label, start, "end" FROM p_spans')
def page_positions(t: Tables) -> DataFrame:
    return t.page_spans


@query("page_spans", 'SELECT doc_id, page_index, label, start, "end" FROM p_spans WHERE "end" > start')
def page_spans(t: Tables) -> DataFrame:
    return spans.page_spans(t.pages, skip_empty=True)


@query("paragraph_spans", 'SELECT doc_id, seq, start, "end", text FROM d_paragraphs')
def paragraph_spans(t: Tables) -> DataFrame:
    return spans.paragraph_spans(t.texts)


@query("section_spans", 'SELECT doc_id, seq, level::INT AS level, title, start, "end" FROM d_sections')
def section_spans(t: Tables) -> DataFrame:
    return t.sections


@query("span_text", 'SELECT s.doc_id, s.seq, substring(t.text, s.start + 1, s."end" - s.start) AS text, s."end" - s.start AS size FROM d_sections s JOIN d_text t USING (doc_id)')
def span_text(t: Tables) -> DataFrame:
    whole = t.sections.join(t.texts, "doc_id")
    return whole.select("doc_id", "seq", spans.text_range(F.col("text"), F.col("start"), F.col("end")).alias("text"), (F.col("end") - F.col("start")).alias("size"))


@query("page_for_position", 'SELECT r.doc_id, r.k, r.position, p.page_index, p.label FROM d_refs r JOIN p_spans p ON r.doc_id = p.doc_id AND p.start <= r.position AND r.position < p."end"')
def page_for_position(t: Tables) -> DataFrame:
    return spans.page_for_position(t.refs.select("doc_id", "k", "position"), t.page_spans, ["doc_id", "k"]).select("doc_id", "k", "position", "page_index", "label")


@query("position_to_page", "SELECT w.doc_id, w.page_index, coalesce(p.start, 0) AS start FROM (SELECT doc_id, page_index + 1 AS page_index FROM d_pages) w LEFT JOIN p_spans p USING (doc_id, page_index)")
def position_to_page(t: Tables) -> DataFrame:
    return spans.position_to_page(t.pages.select("doc_id", (F.col("page_index") + 1).alias("page_index")), t.page_spans)


@query("section_for_position", """SELECT doc_id, k, position, seq, title FROM (SELECT r.doc_id, r.k, r.position, s.seq, s.title, row_number() OVER (PARTITION BY r.doc_id, r.k ORDER BY s.level DESC, s.seq) AS n
    FROM d_refs r JOIN d_sections s ON r.doc_id = s.doc_id AND s.start <= r.position AND r.position < s."end") WHERE n = 1""")
def section_for_position(t: Tables) -> DataFrame:
    return spans.section_for_position(t.refs.select("doc_id", "k", "position"), t.sections, ["doc_id", "k"]).select("doc_id", "k", "position", "seq", "title")


@query("pages_in_range", f'SELECT r.doc_id, r.page_index, p.label FROM ({_RANGES}) r JOIN p_spans p ON r.doc_id = p.doc_id AND p.start < r.to_pos AND r.from_pos < p."end"')
def pages_in_range(t: Tables) -> DataFrame:
    return spans.in_range(_ranges(t), t.page_spans.select("doc_id", "label", "start", "end")).select("doc_id", "page_index", "label")


@query("sections_in_range", f'SELECT r.doc_id, r.page_index, s.seq, s.title FROM ({_RANGES}) r JOIN d_sections s ON r.doc_id = s.doc_id AND s.start < r.to_pos AND r.from_pos < s."end"')
def sections_in_range(t: Tables) -> DataFrame:
    return spans.in_range(_ranges(t), t.sections).select("doc_id", "page_index", "seq", "title")


@query("section_for_range", f"""SELECT doc_id, page_index, title FROM (SELECT r.doc_id, r.page_index, s.title, row_number() OVER (PARTITION BY r.doc_id, r.page_index ORDER BY s.level, s.seq) AS n
    FROM ({_RANGES}) r JOIN d_sections s ON r.doc_id = s.doc_id AND s.start < r.to_pos AND r.from_pos < s."end") WHERE n = 1""")
def section_for_range(t: Tables) -> DataFrame:
    return spans.section_for_range(_ranges(t), t.sections, ["doc_id", "page_index"]).select("doc_id", "page_index", "title")


@query("citations_in_range", f'SELECT r.doc_id, r.page_index, c.k, c.text FROM ({_RANGES}) r JOIN d_cites c ON r.doc_id = c.doc_id AND c.start < r.to_pos AND r.from_pos < c."end"')
def citations_in_range(t: Tables) -> DataFrame:
    return spans.in_range(_ranges(t), t.cites).select("doc_id", "page_index", "k", "text")


@query("footnotes_in_range", f"SELECT r.doc_id, r.page_index, f.marker, n.text AS note FROM ({_RANGES}) r JOIN d_refs f ON r.doc_id = f.doc_id AND r.from_pos <= f.position AND f.position < r.to_pos JOIN d_notes n ON n.doc_id = f.doc_id AND n.note_id = f.target_id")
def footnotes_in_range(t: Tables) -> DataFrame:
    return spans.footnotes_in_range(_ranges(t), t.refs, t.notes).select("doc_id", "page_index", "marker", "note")


@query("footnote_refs_in_range", f"SELECT r.doc_id, r.page_index, f.marker, f.position FROM ({_RANGES}) r JOIN d_refs f ON r.doc_id = f.doc_id AND r.from_pos <= f.position AND f.position < r.to_pos")
def footnote_refs_in_range(t: Tables) -> DataFrame:
    return spans.refs_in_range(_ranges(t), t.refs).select("doc_id", "page_index", "marker", "position")


@query("annotations_in_range", f"""SELECT r.doc_id, r.page_index, 'footnote' AS kind, f.position AS start, f.position AS "end" FROM ({_RANGES}) r JOIN d_refs f ON r.doc_id = f.doc_id AND r.from_pos <= f.position AND f.position < r.to_pos
    UNION ALL SELECT r.doc_id, r.page_index, 'citation', c.start, c."end" FROM ({_RANGES}) r JOIN d_cites c ON r.doc_id = c.doc_id AND c.start < r.to_pos AND r.from_pos < c."end" """)
def annotations_in_range(t: Tables) -> DataFrame:
    return spans.annotations_in_range(_ranges(t), {"footnote": t.refs}, {"citation": t.cites.select("doc_id", "start", "end")}).select("doc_id", "page_index", "kind", "start", "end")


@query("section_titles", "SELECT doc_id, string_agg(title, ' | ' ORDER BY start, title) AS items FROM d_sections GROUP BY doc_id")
def section_titles(t: Tables) -> DataFrame:
    return spans.ordered(t.sections, "title")


@query("page_labels", "SELECT doc_id, string_agg(label, ',' ORDER BY start, label) AS items FROM p_spans GROUP BY doc_id")
def page_labels(t: Tables) -> DataFrame:
    return spans.ordered(t.page_spans, "label", sep=",")


@query("paragraph_texts", "SELECT doc_id, string_agg(text, ' | ' ORDER BY seq) AS items FROM d_paragraphs GROUP BY doc_id")
def paragraph_texts(t: Tables) -> DataFrame:
    return spans.ordered(spans.paragraph_spans(t.texts), "text", "seq")


_FIXED = """SELECT doc_id, k::INT AS chunk_index, 'chunk_' || k AS chunk_id, k * 350 AS start, least(k * 350 + 400, n) AS "end", substring(text, k * 350 + 1, least(400, n - k * 350)) AS text FROM (
    SELECT doc_id, text, length(text) AS n, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 400 THEN 1 ELSE ceil((length(text) - 400) / 350)::BIGINT + 1 END)) AS k FROM d_text)"""


@query("chunk_fixed", _FIXED)
def chunk_fixed(t: Tables) -> DataFrame:
    return chunks.to_chunks("fixed", t.texts, t.page_spans, t.sections, max_tokens=100)


_LISTS = """SELECT c.*, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id,
    (SELECT string_agg(label, ',' ORDER BY page_index) FROM p_spans p WHERE p.doc_id = c.doc_id AND p.start < c."end" AND c.start < p."end") AS page_labels,
    (SELECT arg_min(title, level * 100000 + seq) FROM d_sections s WHERE s.doc_id = c.doc_id AND s.start < c."end" AND c.start < s."end") AS section,
    (SELECT string_agg(target_id, ',' ORDER BY position, target_id) FROM d_refs r WHERE r.doc_id = c.doc_id AND c.start <= r.position AND r.position < c."end") AS footnote_refs,
    (SELECT string_agg(text, ',' ORDER BY start, text) FROM d_cites x WHERE x.doc_id = c.doc_id AND x.start < c."end" AND c.start < x."end") AS citations
    FROM (%s) c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)"""


@query("chunk_enriched", _LISTS % _FIXED)
def chunk_enriched(t: Tables) -> DataFrame:
    cut = chunks.to_chunks("fixed", t.texts, t.page_spans, t.sections, max_tokens=100)
    return chunks.enriched(cut, t.page_spans, t.sections, t.refs, t.cites)


@query("chunk_citation", f"""SELECT doc_id, chunk_index, coalesce(d.source || ', ' || d.lang || ', ', '') || 'p. ' || coalesce(nullif(replace(page_labels, ',', '-'), ''), '?') AS citation
    FROM ({_LISTS % _FIXED}) JOIN (SELECT doc_id, source, lang FROM documents) d USING (doc_id)""")
def chunk_citation(t: Tables) -> DataFrame:
    found = chunk_enriched(t).join(t.docs.select("doc_id", "source", "lang"), "doc_id")
    return found.select("doc_id", "chunk_index", chunks.citation(F.col("source"), F.col("lang"), F.col("page_labels")).alias("citation"))


@query("chunk_page", """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1)::INT AS chunk_index, 'page_' || label AS chunk_id, start, "end", substring(t.text, start + 1, "end" - start) AS text
    FROM p_spans JOIN d_text t USING (doc_id)""")
def chunk_page(t: Tables) -> DataFrame:
    return chunks.to_chunks("page", t.texts, t.page_spans, t.sections)


@query("chunk_section", """SELECT doc_id, i::INT AS chunk_index, 'section_' || i || '_' || replace(substring(title, 1, 20), ' ', '_') AS chunk_id, start, "end", substring(t.text, start + 1, "end" - start) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, seq) - 1 AS i FROM d_sections) JOIN d_text t USING (doc_id)""")
def chunk_section(t: Tables) -> DataFrame:
    return chunks.to_chunks("section", t.texts, t.page_spans, t.sections)


@query("chunk_semantic", """, para AS (SELECT *, max(seq) OVER (PARTITION BY doc_id) AS last FROM d_paragraphs),
r AS (SELECT doc_id, -1::BIGINT AS seq, ''::VARCHAR AS cur, 0::BIGINT AS cur_start, 0 AS idx, NULL::VARCHAR AS out_text, NULL::BIGINT AS out_start, NULL::BIGINT AS out_end FROM para WHERE seq = 0
  UNION ALL SELECT r.doc_id, p.seq, CASE WHEN full_ THEN substring(t.text, greatest(p.start - 50, 0) + 1, p.start - greatest(p.start - 50, 0)) || p.text ELSE r.cur || p.text END,
    CASE WHEN full_ THEN greatest(p.start - 50, 0) ELSE r.cur_start END, r.idx + full_::INT, CASE WHEN full_ THEN r.cur END, CASE WHEN full_ THEN r.cur_start END, CASE WHEN full_ THEN p.start END
  FROM r JOIN para p ON p.doc_id = r.doc_id AND p.seq = r.seq + 1 JOIN d_text t ON t.doc_id = r.doc_id, LATERAL (SELECT length(r.cur) + length(p.text) > 2048 AND r.cur <> '' AS full_))
SELECT doc_id, idx - 1 AS chunk_index, 'chunk_' || (idx - 1) AS chunk_id, out_start AS start, out_end AS "end", out_text AS text FROM r WHERE out_text IS NOT NULL
UNION ALL SELECT r.doc_id, idx, 'chunk_' || idx, cur_start, length(t.text), cur FROM r JOIN para p ON p.doc_id = r.doc_id AND p.seq = r.seq AND p.seq = p.last JOIN d_text t ON t.doc_id = r.doc_id""")
def chunk_semantic(t: Tables) -> DataFrame:
    return chunks.to_chunks("semantic", t.texts, t.page_spans, t.sections)
