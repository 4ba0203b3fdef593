"""Exports, sources, conversion, simulated damage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import spans, words
from quire.operators import structure as st
from quire.plans import structure_queries as sq
from quire.plans.convert import convert
from quire.plans.registry import Tables, query
from quire.settings import Conversion, Reading
from quire.sources import export, files


def _titled(t: Tables) -> DataFrame:
    return t.texts.join(t.docs.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("author")), "doc_id")


def _markdown_sql(marker: tuple[str, str] | None, compat: bool) -> str:
    end = "''" if compat else "chr(10)"
    quoted = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    body = "t.text"
    if marker:
        body = f"""(SELECT string_agg({quoted(marker[0])} || label || {quoted(marker[1])} || substring(t.text, start + 1, until - start), '' ORDER BY start) FROM (
            SELECT *, coalesce(lead(start) OVER (ORDER BY start), length(t.text)) AS until FROM p_spans p WHERE p.doc_id = t.doc_id))"""
    return f"""SELECT t.doc_id, '---' || {end} || 'title: ' || d.source || {end} || 'author: ' || d.lang || {end} || '---' || {end} || {end} || {body} || coalesce(n.notes, '') AS markdown
        FROM d_text t JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Notes' || chr(10) || string_agg(chr(10) || '[^' || replace(note_id, 'fn', '') || ']: ' || text || chr(10), '' ORDER BY note_id) AS notes
        FROM d_notes GROUP BY doc_id) n ON n.doc_id = t.doc_id"""


@query("markdown_plain", _markdown_sql(None, False))
def markdown_plain(t: Tables) -> DataFrame:
    return export.markdown(_titled(t), t.page_spans, t.notes)


@query("markdown_compat", _markdown_sql(None, True))
def markdown_compat(t: Tables) -> DataFrame:
    return export.markdown(_titled(t), t.page_spans, t.notes, compat=True)


@query("markdown_comment", _markdown_sql(export.MARKERS["comment"], False))
def markdown_comment(t: Tables) -> DataFrame:
    return export.markdown(_titled(t), t.page_spans, t.notes, "comment")


@query("markdown_heading", _markdown_sql(export.MARKERS["heading"], False))
def markdown_heading(t: Tables) -> DataFrame:
    return export.markdown(_titled(t), t.page_spans, t.notes, "heading")


@query("markdown_inline", _markdown_sql(export.MARKERS["inline"], False))
def markdown_inline(t: Tables) -> DataFrame:
    return export.markdown(_titled(t), t.page_spans, t.notes, "inline")


@query("plain_text", "SELECT doc_id, text FROM d_text")
def plain_text(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", "text")


@query("json_round_trip", """SELECT t.doc_id, '1.0' AS version, t.text, (SELECT count(*) FROM p_spans p WHERE p.doc_id = t.doc_id)::INT AS n_pages, (SELECT arg_max(label, start) FROM p_spans p WHERE p.doc_id = t.doc_id) AS last_label,
    (SELECT count(*) FROM d_sections s WHERE s.doc_id = t.doc_id)::INT AS n_sections, (SELECT string_agg(title, '|' ORDER BY start, title) FROM d_sections s WHERE s.doc_id = t.doc_id) AS titles,
    (SELECT count(*) FROM d_paragraphs p WHERE p.doc_id = t.doc_id)::INT AS n_paragraphs FROM d_text t""")
def json_round_trip(t: Tables) -> DataFrame:
    back = files.from_json(files.to_json(t.texts, t.page_spans, t.sections, spans.paragraph_spans(t.texts)))
    titles = F.nullif(F.array_join(F.transform("sections", lambda s: s["title"]), "|"), F.lit(""))
    return back.select("doc_id", "version", "text", F.size("pages").alias("n_pages"), F.element_at("pages", -1)["label"].alias("last_label"), F.size("sections").alias("n_sections"), titles.alias("titles"), F.size("paragraphs").alias("n_paragraphs"))


_TREE = "SELECT doc_id, seq, level::INT AS level, title, (SELECT max(p.seq) FROM d_outline p WHERE p.doc_id = o.doc_id AND p.seq < o.seq AND p.level < o.level) AS parent FROM d_outline o"


@query("toc_tree", _TREE)
def toc_tree(t: Tables) -> DataFrame:
    return export.contents_tree(t.outline)


@query("toc_paths", f"SELECT doc_id, seq, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN parent IS NULL THEN '' ELSE parent || '/' END || seq AS path FROM ({_TREE})")
def toc_paths(t: Tables) -> DataFrame:
    return export.contents_paths(toc_tree(t))


def _producers(t: Tables) -> DataFrame:
    lang, n = F.col("lang"), F.col("n_chars")
    producer = F.when(lang == "en", F.when(n > 2000, "Adobe Acrobat Pro DC 15 Paper Capture Plug-in").otherwise("ABBYY FineReader 12.1 x")).when(lang == "fr", "Some scanner").when(lang == "de", "TeX")
    creator = F.when(lang == "es", "Tesseract 5.3.0").when(lang == "en", "word")
    return t.docs.select("doc_id", producer.alias("producer"), creator.alias("creator"))


@query("ocr_source", """SELECT doc_id, CASE WHEN lang = 'en' AND n_chars > 2000 THEN 'adobe_paper_capture' WHEN lang = 'en' THEN 'abbyy_finereader' WHEN lang = 'es' THEN 'tesseract' WHEN lang = 'fr' THEN 'unknown_ocr' ELSE 'unknown' END AS engine,
    CASE WHEN lang = 'en' AND n_chars > 2000 THEN 'Acrobat Pro DC 15' WHEN lang = 'en' THEN '12.1' WHEN lang = 'es' THEN '5.3.0' ELSE '' END AS version, CASE WHEN lang = 'en' THEN 0.95 WHEN lang = 'es' THEN 0.9 WHEN lang = 'fr' THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM documents""")
def ocr_source(t: Tables) -> DataFrame:
    engine, version, sure = export.scan_source(F.col("producer"), F.col("creator"))
    return _producers(t).select("doc_id", engine.alias("engine"), version.alias("version"), sure.alias("confidence"))


@query("detect_format", "SELECT doc_id, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'epub' WHEN 'de' THEN 'markdown' WHEN 'es' THEN CASE WHEN n_chars > 1000 THEN 'pdf' END END AS format FROM documents")
def detect_format(t: Tables) -> DataFrame:
    ending = F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "fr", ".EPUB").when(F.col("lang") == "de", ".markdown").otherwise("")
    head = F.when((F.col("lang") == "es") & (F.col("n_chars") > 1000), "%PDF-1.7").otherwise("Some te")
    return t.docs.select("doc_id", files.format_of(F.concat(F.lit("/a.b/"), F.col("doc_id").cast("string"), ending), head).alias("format"))


@query("supported_formats", "SELECT unnest(['markdown']) AS format")
def supported_formats(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(f,) for f in files.supported()], "format string")


@query("reocr_decision", """SELECT doc_id, pos::INT AS pos, CASE WHEN word <> '' AND length(token) >= 5 AND word <> token THEN word ELSE token END AS text, CASE WHEN word = '' THEN 'empty' WHEN length(token) < 5 THEN 'unsure' WHEN word = token THEN 'same' ELSE 'replaced' END AS decision FROM d_tokens""")
def reocr_decision(t: Tables) -> DataFrame:
    again, sure = F.col("word"), F.length("token") / 10
    decision = F.when(again == "", "empty").when(sure < 0.5, "unsure").when(again == F.col("token"), "same").otherwise("replaced")
    return words.tokens(t.degraded).select("doc_id", "pos", F.when(decision == "replaced", again).otherwise(F.col("token")).alias("text"), decision.alias("decision"))


@query("reocr_statistics", """SELECT doc_id, count(*) AS processed, count(*) FILTER (WHERE word <> '' AND length(token) >= 5 AND word <> token) AS replaced, count(*) FILTER (WHERE NOT (word <> '' AND length(token) >= 5 AND word <> token)) AS kept FROM d_tokens GROUP BY doc_id""")
def reocr_statistics(t: Tables) -> DataFrame:
    d = F.col("decision") == "replaced"
    return reocr_decision(t).groupBy("doc_id").agg(F.count("*").alias("processed"), F.count_if(d).alias("replaced"), F.count_if(~d).alias("kept"))


@query("image_coordinates", "SELECT doc_id, page_index, block_no, trunc(x0 * 300 / 72)::INT AS x0, trunc(y0 * 300 / 72)::INT AS y0, trunc(x1 * 300 / 72)::INT AS x1, trunc(y1 * 300 / 72)::INT AS y1 FROM d_blocks")
def image_coordinates(t: Tables) -> DataFrame:
    to = lambda c: (F.col(c) * 300 / 72).cast("int").alias(c)
    return t.blocks.select("doc_id", "page_index", "block_no", to("x0"), to("y0"), to("x1"), to("y1"))


@query("simulated_damage", """SELECT doc_id, string_agg(CASE WHEN h IN ('0', '1') THEN replace(w, 'e', 'c') WHEN h = '2' AND length(w) >= 6 THEN substring(w, 1, 3) || '-' || chr(10) || substring(w, 4) WHEN h = '3' AND w[1] <> 'ß' THEN upper(w[1]) || w[2:] ELSE w END || CASE WHEN h = '4' THEN '' ELSE ' ' END, '' ORDER BY i) AS text FROM (
    SELECT doc_id, i, w, md5(doc_id || ':' || i)[1] AS h FROM (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS ws FROM documents))) GROUP BY doc_id""")
def simulated_damage(t: Tables) -> DataFrame:
    w = tx.words(F.col("text"))

    def damage(x, i):
        h = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), i.cast("string"))), 1, 1)
        new = (
            F.when(h.isin("0", "1"), F.replace(x, F.lit("e"), F.lit("c")))
            .when((h == "2") & (F.length(x) >= 6), F.concat(F.substring(x, 1, 3), F.lit("-\n"), F.substring(x, F.lit(4), F.length(x))))
            .when((h == "3") & ~F.startswith(x, F.lit("ß")), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
            .otherwise(x)
        )
        return F.concat(new, F.when(h == "4", "").otherwise(" "))

    return t.docs.where(F.size(w) > 0).select("doc_id", F.array_join(F.transform(w, damage), "").alias("text"))


_WEIGHTS = (("book", "has_contents", 0.3), ("book", "has_outline", 0.3), ("article", "has_abstract", 0.5), ("article", "few_pages", 0.2), ("essay", "few_pages", 0.3), ("report", "has_numbers", 0.4), ("report", "has_contents", 0.2))


@query("profile_scores", f"""SELECT doc_id, type, round(sum(w)::DOUBLE, 6) AS score FROM (SELECT doc_id, unnest(['has_contents', 'has_outline', 'has_abstract', 'has_numbers', 'few_pages']) AS indicator, unnest([has_contents, has_outline, has_abstract, has_numbers, n_pages < 30]) AS yes FROM ({sq._IND}))
    JOIN (VALUES {', '.join(str(x) for x in _WEIGHTS)}) v(type, indicator, w) USING (indicator) WHERE yes GROUP BY ALL""")
def profile_scores(t: Tables) -> DataFrame:
    ind = st.indicators(sq._with_contents(t), t.outline).withColumn("few_pages", F.col("n_pages") < 30)
    names = ["has_contents", "has_outline", "has_abstract", "has_numbers", "few_pages"]
    long = ind.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("indicator"))
    weights = t.spark.createDataFrame(_WEIGHTS, "type string, indicator string, w double")
    return long.join(F.broadcast(weights), "indicator").groupBy("doc_id", "type").agg(F.round(F.sum("w"), 6).alias("score"))


def _converted(t: Tables) -> dict[str, DataFrame]:
    return convert(t.pages, t.blocks, t.outline, t.lexicon, Conversion(reading=Reading(enabled=True)))


@query("convert_documents")
def convert_documents(t: Tables) -> DataFrame:
    return _converted(t)["documents"]


@query("convert_quality")
def convert_quality(t: Tables) -> DataFrame:
    return _converted(t)["quality"]
