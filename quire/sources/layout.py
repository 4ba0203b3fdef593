"""A positioned layout for a table of plain texts: lines, pages, blocks, outline, contents page, references and notes.

Everything follows from the text itself, row by row and without a shuffle, so that a corpus without layout can be run
through every operator that needs one. Pages have LINES lines; a blank line parts a page's two halves into paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES, HALF = 8, 4


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def _pages(docs: DataFrame) -> DataFrame:
    split = docs.where(F.col("text").isNotNull()).select("doc_id", F.split("text", "\n", -1).alias("all"))
    last = F.floor((F.size("all") - 1) / LINES).cast("int")
    return split.select("doc_id", "all", F.explode(F.sequence(F.lit(0), last)).alias("p")).select(
        "doc_id", F.col("p").cast("long").alias("page_index"), F.slice("all", F.col("p") * LINES + 1, F.lit(LINES)).alias("on")
    )


def label(index: Column) -> Column:
    return F.when(index == 0, "i").when(index == 1, "ii").otherwise((index - 1).cast("string"))


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_index, label, text."""
    halves = F.array(F.array_join(F.slice("on", 1, HALF), "\n"), F.when(F.size("on") > HALF, F.array_join(F.slice("on", HALF + 1, LINES), "\n")))
    return _pages(docs).select("doc_id", "page_index", label(F.col("page_index")).alias("label"), F.array_join(F.array_compact(halves), "\n\n").alias("text"))


def blocks(docs: DataFrame) -> DataFrame:
    """One block for each line: doc_id, page_index, block_no, text, x0, y0, x1, y1, font_name, font_size, flags."""
    of = lines(docs).select("doc_id", F.floor(F.col("line_no") / LINES).alias("page_index"), F.pmod("line_no", F.lit(LINES)).cast("int").alias("block_no"), "text")
    no, n = F.col("block_no"), F.length("text")
    x0 = F.lit(72.0) + F.when(no == 4, 36.0).otherwise(0.0)
    y0 = F.lit(72.0) + no * 14.0
    return of.select(
        "doc_id", "page_index", "block_no", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.least(n, F.lit(90)) * 5.0).alias("x1"), (y0 + 12.0).alias("y1"),
        F.when(no == 0, "Serif-Bold").otherwise("Serif").alias("font_name"),
        (F.lit(11.0) + F.when(no == 0, 6.0).when(n < 40, 3.0).otherwise(0.0)).alias("font_size"),
        (F.when(no == 0, 16).otherwise(0) + F.when(no == 5, 2).otherwise(0)).alias("flags"),
    )


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, seq, level, title, page_index: the first line of every page of documents that have several pages."""
    many = docs.where(F.size(F.split("text", "\n", -1)) > LINES)
    title = F.trim(F.substring(F.element_at("on", 1), 1, 60))
    return _pages(many).select("doc_id", F.col("page_index").cast("int").alias("seq"), F.when(F.col("page_index") % 3 == 0, 1).otherwise(2).alias("level"), title.alias("title"), "page_index")


def contents_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_index (-1), text: a contents page made of the outline."""
    many = docs.where(F.size(F.split("text", "\n", -1)) > LINES).select("doc_id", F.split("text", "\n", -1).alias("all"))
    heads = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("all") - 1) / LINES).cast("int")),
        lambda p: F.concat(F.trim(F.substring(F.element_at("all", p * LINES + 1), 1, 60)), F.lit(" ..... "), (p + 1).cast("string")),
    )
    return many.select("doc_id", F.lit(-1).cast("long").alias("page_index"), F.concat(F.lit("Table of Contents\n"), F.array_join(heads, "\n")).alias("text"))


def references(docs: DataFrame, each: int = 5) -> DataFrame:
    """doc_id, k, position, marker, target_id: note markers spread over each text."""
    some = docs.where(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
    return some.select("doc_id", "k", F.pmod(F.col("doc_id") * 7919 + F.col("k") * 613, F.col("n")).alias("position"), (F.col("k") + 1).cast("string").alias("marker"), F.concat(F.lit("fn"), F.col("k")).alias("target_id"))


def notes(docs: DataFrame, each: int = 5) -> DataFrame:
    """doc_id, note_id, text for two of three references."""
    of = references(docs, each).where(F.col("k") % 3 != 2)
    return of.select("doc_id", F.col("target_id").alias("note_id"), F.concat(F.lit("Note "), F.col("marker")).alias("text"))


def citations(docs: DataFrame, each: int = 5) -> DataFrame:
    """doc_id, k, start, end, text: ten characters after each reference."""
    of = references(docs, each).join(docs.select("doc_id", "text"), "doc_id")
    end = F.least(F.col("position") + 10, F.length("text"))
    return of.select("doc_id", "k", F.col("position").alias("start"), end.alias("end"), F.substring("text", F.col("position").cast("int") + 1, (end - F.col("position")).cast("int")).alias("text"))


def degraded(docs: DataFrame) -> DataFrame:
    """doc_id, text with the errors that scanning makes: confused letters, line-break hyphens, capitals, digits and bars in words, doubled marks."""
    text = F.regexp_replace("text", " the ([aeiou])", " tbe $1")
    text = F.regexp_replace(text, "([A-Za-z]{3})(ing|tion)([,.])", "$1-\n$2$3")
    text = F.regexp_replace(text, "([a-z]{2})a([a-z]{3})\\.", "$1A$2.")
    text = F.regexp_replace(text, " ([a-z]{2})o([a-z]{2}), ", " $10$2,, ")
    text = F.regexp_replace(text, "([a-z]{3})l([a-z])\n", "$1|$2\n")
    return docs.select("doc_id", text.alias("text"))


#: The same as common table expressions for DuckDB over the table documents.
SQL = {
    "d_lines": "SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)",
    "d_pages": """SELECT doc_id, page_index, CASE page_index WHEN 0 THEN 'i' WHEN 1 THEN 'ii' ELSE (page_index - 1)::VARCHAR END AS label,
        string_agg(text || CASE WHEN line_no = last THEN '' WHEN line_no % 4 = 3 THEN chr(10) || chr(10) ELSE chr(10) END, '' ORDER BY line_no) AS text
        FROM (SELECT doc_id, line_no, text, (line_no // 8)::BIGINT AS page_index, max(line_no) OVER (PARTITION BY doc_id, line_no // 8) AS last FROM d_lines) GROUP BY doc_id, page_index""",
    "d_blocks": """SELECT doc_id, (line_no // 8)::BIGINT AS page_index, (line_no % 8)::INT AS block_no, text, 72.0::DOUBLE + CASE WHEN line_no % 8 = 4 THEN 36 ELSE 0 END AS x0,
        72.0::DOUBLE + 14 * (line_no % 8) AS y0, 72.0::DOUBLE + CASE WHEN line_no % 8 = 4 THEN 36 ELSE 0 END + least(length(text), 90) * 5 AS x1, 84.0::DOUBLE + 14 * (line_no % 8) AS y1,
        CASE WHEN line_no % 8 = 0 THEN 'Serif-Bold' ELSE 'Serif' END AS font_name, 11.0::DOUBLE + CASE WHEN line_no % 8 = 0 THEN 6 WHEN length(text) < 40 THEN 3 ELSE 0 END AS font_size,
        (CASE WHEN line_no % 8 = 0 THEN 16 ELSE 0 END + CASE WHEN line_no % 8 = 5 THEN 2 ELSE 0 END)::INT AS flags FROM d_lines""",
    "d_outline": """SELECT doc_id, (line_no // 8)::INT AS seq, CASE WHEN (line_no // 8) % 3 = 0 THEN 1 ELSE 2 END AS level, trim(substring(text, 1, 60)) AS title, (line_no // 8)::BIGINT AS page_index
        FROM d_lines WHERE line_no % 8 = 0 AND doc_id IN (SELECT doc_id FROM d_lines WHERE line_no = 8)""",
    "d_contents": """SELECT doc_id, -1::BIGINT AS page_index, 'Table of Contents' || chr(10) || string_agg(title || ' ..... ' || (seq + 1), chr(10) ORDER BY seq) AS text FROM d_outline GROUP BY doc_id""",
    "d_refs": """SELECT doc_id, k, (doc_id * 7919 + k * 613) % length(text) AS position, (k + 1)::VARCHAR AS marker, 'fn' || k AS target_id
        FROM documents, (SELECT unnest(range(5))::INT AS k) WHERE length(text) > 0""",
    "d_notes": "SELECT doc_id, target_id AS note_id, 'Note ' || marker AS text FROM d_refs WHERE k % 3 <> 2",
    "d_cites": """SELECT r.doc_id, k, position AS start, least(position + 10, length(d.text)) AS \"end\", substring(d.text, position + 1, least(10, length(d.text) - position)) AS text
        FROM d_refs r JOIN documents d USING (doc_id)""",
    "d_degraded": """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' the ([aeiou])', ' tbe \\1', 'g'),
        '([A-Za-z]{3})(ing|tion)([,.])', '\\1-' || chr(10) || '\\2\\3', 'g'), '([a-z]{2})a([a-z]{3})\\.', '\\1A\\2.', 'g'), ' ([a-z]{2})o([a-z]{2}), ', ' \\10\\2,, ', 'g'),
        '([a-z]{3})l([a-z])' || chr(10), '\\1|\\2' || chr(10), 'g') AS text FROM documents""",
    # positions of pages and paragraphs of the whole text
    "p_start": "SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d_pages",
    "p_spans": "SELECT doc_id, page_index, label, start, start + length(text) AS \"end\" FROM p_start",
    "d_text": "SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_index) FILTER (WHERE text <> ''), '') AS text FROM d_pages GROUP BY doc_id",
    "d_sections": """SELECT o.doc_id, o.seq, o.level, o.title, p.start, coalesce(lead(p.start) OVER (PARTITION BY o.doc_id ORDER BY p.start, o.seq), length(t.text)) AS \"end\"
        FROM d_outline o JOIN p_spans p ON o.doc_id = p.doc_id AND o.page_index = p.page_index JOIN d_text t ON t.doc_id = o.doc_id""",
    "d_paragraphs": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS seq, start, start + length(part) AS \"end\", part AS text FROM (
        SELECT doc_id, i, part, (coalesce(sum(length(part) + sep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM (
        SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part, unnest(list_concat(list_transform(seps, lambda s: length(s)), [0])) AS sep FROM (
        SELECT doc_id, regexp_split_to_array(text, '\\n\\n+') AS parts, regexp_extract_all(text, '\\n\\n+') AS seps FROM d_text))) WHERE part <> ''""",
    "d_lexicon": """SELECT word, count(DISTINCT doc_id) AS doc_freq, count(*) AS freq, log10(count(*) * 1e9 / any_value(total)) AS zipf FROM (
        SELECT doc_id, word, count(*) OVER () AS total FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents)) GROUP BY word HAVING count(DISTINCT doc_id) >= 5""",
    "d_tokens": """SELECT doc_id, pos, token, trim(regexp_replace(lower(token), '[^\\p{L}\\p{N}_'']', '', 'g'), '''') AS word FROM (
        SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM d_degraded))""",
}


def sql(body: str) -> str:
    """body with the definitions of the tables above that it needs."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, definition in SQL.items():
            if name in text and name not in need:
                add(definition)
                need.append(name)

    add(body)
    order = [n for n in SQL if n in need]
    order.sort(key=need.index)
    if not order:
        return body
    more = body.lstrip()
    # a body may go on with definitions of its own, which may be recursive
    head = "WITH RECURSIVE " if more.startswith(",") else "WITH "
    return head + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + ("" if more.startswith(",") else "\n") + more
