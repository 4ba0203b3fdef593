"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import chat, decontaminate, html, jaccard_join, language_id, licenses, line_dedup, pieces, quality, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the SQL has the number of documents that profiles are made from; the bound is learned from all
    return language_id.identify(docs, language_id.train(docs, language_id.PER_LANGUAGE), max_distance=language_id.learn_bound(docs))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return chat.parse(chat.transcripts(conversations), chat.train(conversations))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_license_scan": op8_license_scan,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
}

_GRAMS = """SELECT {key}, g, lpad(g, 3, chr(1)) AS o, count(*) AS n FROM (SELECT {key}, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substring(w, i, 1)),
    list_transform(range(1, length(w) + 2), lambda i: substring(' ' || w || ' ', i, 2)), list_transform(range(1, length(w) + 1), lambda i: substring(' ' || w || ' ', i, 3)))) AS g FROM (
    SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS w FROM {table})) GROUP BY {key}, g"""

ORACLES: dict[str, str] = {
    "op6_language_id": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, lang FROM documents),
ids AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL) WHERE r <= 400),
s AS (SELECT lang, text FROM documents WHERE doc_id IN (SELECT doc_id FROM ids) AND lang IS NOT NULL AND text IS NOT NULL),
p AS (SELECT lang, g, r FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, o) - 1 AS r FROM ({_GRAMS.format(key="lang", table="s")})) WHERE r < 300),
t AS (SELECT k, g, r, count(*) OVER (PARTITION BY k) AS size FROM (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY n DESC, o) - 1 AS r FROM ({_GRAMS.format(key="k", table="d")})) WHERE r < 300),
a AS (SELECT k, lang, sum(coalesce(abs(t.r - p.r), 300))::BIGINT / (any_value(size) * 300) AS far FROM (SELECT * FROM t, (SELECT DISTINCT lang FROM p)) t LEFT JOIN p USING (lang, g) GROUP BY k, lang),
b AS (SELECT k, lang, far, row_number() OVER (PARTITION BY k ORDER BY far, lang) AS n, lead(far) OVER (PARTITION BY k ORDER BY far, lang) AS runner FROM a)
SELECT doc_id, coalesce(b.lang, 'und') AS language, round(far, 6) AS distance, round(runner - far, 6) AS margin,
  coalesce(far <= 0.8 AND length(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]', '', 'g')) / greatest(length(regexp_replace(lower(text), '[ \\t\\n\\r\\f]', '', 'g')), 1) >= 0.5, false) AS accepted
FROM d LEFT JOIN b ON b.k = d.k AND b.n = 1
""",
    "op1_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT k, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
h AS (SELECT *, trim(regexp_replace(lower(line), '[ \\t\\r\\f]+', ' ', 'g'), ' ') AS norm FROM l),
c AS (SELECT norm FROM h WHERE norm <> '' AND doc_id IS NOT NULL GROUP BY norm HAVING count(DISTINCT doc_id) > 10),
kept AS (SELECT k, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM h WHERE norm NOT IN (SELECT norm FROM c) GROUP BY k)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(len(ls), 0)::INT AS n_lines, (coalesce(len(ls), 0) - coalesce(kept.n, 0))::INT AS n_dropped
FROM d LEFT JOIN kept USING (k)
""",
    "op3_quality_rules": quality.oracle(),
    "op4_decontamination": """
WITH dw AS (SELECT row_number() OVER () AS t, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT t, doc_id, unnest(range(1, len(ws) - 1)) AS pos, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM dw WHERE len(ws) >= 3),
iw AS (SELECT row_number() OVER () AS u, item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT u, item_id, len(ws) - 2 AS width, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM iw WHERE len(ws) >= 3),
n AS (SELECT u, count(*) AS s FROM i GROUP BY u),
p AS (SELECT t, doc_id, u, item_id, width, s, pos, g FROM ds JOIN i USING (g) JOIN n USING (u)),
few AS (SELECT t, u FROM p GROUP BY t, u, s HAVING count(DISTINCT g) >= ceil(s * 0.6 - 1e-9)),
w AS (SELECT x.t, x.doc_id, x.u, x.item_id, x.s, x.pos, count(DISTINCT y.g) AS held
      FROM p x SEMI JOIN few ON x.t = few.t AND x.u = few.u JOIN p y ON x.t = y.t AND x.u = y.u AND y.pos >= x.pos AND y.pos < x.pos + x.width GROUP BY ALL)
SELECT doc_id, item_id, round(max(held / s), 6) AS containment FROM w WHERE held >= ceil(s * 0.6 - 1e-9) GROUP BY doc_id, item_id
""",
    "op5_jaccard_join": """
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS gs FROM w WHERE len(ws) > 0),
m AS (SELECT doc_id, md5(array_to_string(gs, '|')) AS node, len(gs) AS n, gs FROM g),
s AS (SELECT DISTINCT node, n, unnest(gs) AS g FROM m),
p AS (SELECT x.node AS a, y.node AS b FROM s x JOIN s y ON x.g = y.g AND x.node <> y.node GROUP BY x.node, y.node, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.45),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM m x JOIN m y USING (node) UNION SELECT x.doc_id, y.doc_id FROM p JOIN m x ON x.node = p.a JOIN m y ON y.node = p.b),
r(doc_id, head) AS (SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, r.head FROM r JOIN e ON e.a = r.doc_id WHERE r.head < e.b),
links AS (SELECT a AS node, count(*) AS n FROM p GROUP BY a), copies AS (SELECT node, count(*) - 1 AS n FROM m GROUP BY node),
c AS (SELECT doc_id, max(coalesce(links.n, 0)) AS n_links, max(copies.n) AS n_copies FROM m JOIN copies USING (node) LEFT JOIN links USING (node) GROUP BY doc_id)
SELECT r.doc_id, min(head) AS class_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links, coalesce(any_value(n_copies), 0)::BIGINT AS n_copies FROM r LEFT JOIN c USING (doc_id) GROUP BY r.doc_id
""",
}
