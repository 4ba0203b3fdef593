"""Surveys, metrics, samples, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import survey
from quire.operators import structure as st
from quire.plans import structure_queries as sq
from quire.plans.registry import Tables, query
from quire.sources import layout

_PAGES = "SELECT doc_id, (line_no // 8)::BIGINT AS page_index, string_agg(text, chr(10) ORDER BY line_no) AS text FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d_degraded)) GROUP BY ALL"


def _pages(t: Tables) -> DataFrame:
    """doc_id, page_index, text: a text cut after each eight lines, within its row; what follows the last cut is a page too, an empty one as well."""
    cut = F.regexp_extract_all("text", F.lit("(?:[^\\n]*+\\n){8}|(?s:.+)\\z"), F.lit(0))
    full = lambda page: F.regexp_count(page, F.lit("\\n")) == 8
    some = t.degraded.where(F.col("text").isNotNull()).select("doc_id", cut.alias("cut"))
    ended = F.coalesce(full(F.try_element_at("cut", F.lit(-1))), F.lit(True))
    of = some.select("doc_id", F.posexplode(F.concat("cut", F.when(ended, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))).alias("page_index", "page"))
    return of.select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.when(full("page"), F.substring("page", F.lit(1), F.length("page") - 1)).otherwise(F.col("page")).alias("text"))


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_QUALITY = f"""SELECT doc_id, page_index, n_words, n_chars, n_garbage, garbage, valid, CASE WHEN n_chars = 0 THEN 'no_text_layer' ELSE concat_ws(',', CASE WHEN regexp_matches(text, '[α-ω]{{16,}}') THEN 'garbled_greek' END,
      CASE WHEN regexp_matches(text, '[äöüÄÖÜß]{{2}}') THEN 'umlaut_errors' END,
      CASE WHEN page_index < 50 AND len(list_filter(words, lambda w: regexp_full_match(w, '[ivxlcdm]{{2,}}'))) = 0 AND len(list_filter(words, lambda w: regexp_full_match(w, '[1il][vx]'))) > 0 THEN 'roman_numeral_confusion' END,
      CASE WHEN regexp_matches(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹]') AND NOT regexp_matches(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹][ \\t\\n\\r\\f]*$') AND regexp_matches(text, '[ \\t\\n\\r\\f][⁰¹²³⁴⁵⁶⁷⁸⁹]+[ \\t\\n\\r\\f]') THEN 'floating_superscripts' END,
      CASE WHEN len(list_filter(words, lambda w: regexp_full_match(w, '[a-z]{{20,}}'))) > 0 THEN 'merged_words' END,
      CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}_]-[ \\t\\r\\f]*\\n[ \\t\\n\\r\\f]*[\\p{{L}}\\p{{N}}_]') THEN 'broken_hyphenation' END, CASE WHEN garbage > 0.05 THEN 'high_garbage_ratio' END, CASE WHEN valid < 0.5 THEN 'low_valid_words' END) END AS issues,
    CASE WHEN n_words < 10 THEN 'SKIP' WHEN garbage > 0.02 OR valid < 0.5 THEN 'BAD' WHEN garbage > 0.005 OR valid < 0.8 THEN 'MARGINAL' ELSE 'GOOD' END AS verdict FROM (
    SELECT *, CASE WHEN n_chars = 0 THEN 0.0 ELSE round(n_garbage::DOUBLE / n_chars, 6) END::DOUBLE AS garbage, CASE WHEN n_chars = 0 OR len(alpha) = 0 THEN 0.0 ELSE round(len(list_filter(alpha, lambda w:
      w IN ('the', 'and', 'that', 'this', 'with', 'from', 'which', 'have', 'been', 'being', 'consciousness', 'reason', 'knowledge', 'truth', 'nature', 'world', 'mind', 'thought', 'experience', 'existence', 'reality', 'philosophy', 'concept',
        'theory', 'argument', 'question', 'answer', 'chapter', 'section', 'introduction', 'conclusion', 'notes', 'index', 'sein', 'dasein', 'nicht', 'aber', 'oder', 'wenn', 'durch', 'logos', 'nous', 'physis', 'techne', 'polis')
      OR (regexp_matches(w, '[aeiou]') AND regexp_matches(w, '[bcdfghjklmnpqrstvwxyz]') AND NOT regexp_matches(w, '{"|".join(c + "{4}" for c in "abcdefghijklmnopqrstuvwxyz")}')))) / len(alpha), 6) END::DOUBLE AS valid FROM (
    SELECT doc_id, page_index, text, {_TOKENS} AS words, list_filter({_TOKENS}, lambda w: regexp_full_match(w, '[a-z]{{3,}}')) AS alpha, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))::INT AS n_words,
      CASE WHEN regexp_matches(text, '[^ \\t\\n\\r\\f]') THEN length(text) ELSE 0 END::INT AS n_chars, CASE WHEN NOT regexp_matches(text, '[^ \\t\\n\\r\\f]') THEN 0 ELSE
      len(regexp_extract_all(text, '[^\\x{{0}}-\\x{{7f}}\\x{{c0}}-\\x{{24f}}\\x{{370}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1fff}}]')) + len(regexp_extract_all(text, '[\\x{{0}}-\\x{{8}}\\x{{b}}\\x{{c}}\\x{{e}}-\\x{{1f}}]'))
      + len(regexp_extract_all(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+[a-z]+')) + len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{10,}}')))
      + len(regexp_extract_all(text, '[|!1l]{{5,}}')) + len(regexp_extract_all(text, '[oO0]{{5,}}')) END::BIGINT AS n_garbage FROM ({_PAGES})))"""


@query("page_quality", _QUALITY)
def page_quality(t: Tables) -> DataFrame:
    return survey.page_quality(_pages(t))


@query("assess_doc", f"""SELECT doc_id, n_pages, with_text, with_issues, round(garbage, 6) AS garbage, round(valid, 6) AS valid, CASE reason WHEN 'text_layer' THEN 'POOR' WHEN 'garbage' THEN 'POOR' WHEN 'usable' THEN 'ACCEPTABLE' ELSE 'DEGRADED' END AS grade, reason FROM (
    SELECT *, CASE WHEN with_text < n_pages * 0.5 THEN 'text_layer' WHEN garbage > 0.1 THEN 'garbage' WHEN valid < 0.6 THEN 'words' WHEN with_issues > n_pages * 0.3 THEN 'issues' ELSE 'usable' END AS reason FROM (
    SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE n_chars > 0) AS with_text, count(*) FILTER (WHERE issues <> '') AS with_issues, CASE WHEN sum(n_chars) = 0 THEN 1.0 ELSE sum(n_garbage)::DOUBLE / sum(n_chars)::BIGINT END::DOUBLE AS garbage,
      CASE WHEN count(*) FILTER (WHERE valid > 0) = 0 THEN 0.0 ELSE sum(round(valid * 1e6)::BIGINT)::BIGINT / count(*) FILTER (WHERE valid > 0) / 1e6 END::DOUBLE AS valid FROM ({_QUALITY}) GROUP BY doc_id))""")
def assess_doc(t: Tables) -> DataFrame:
    return survey.assess(page_quality(t))


@query("page_issues", f"SELECT doc_id, issue, count(*) AS n FROM (SELECT doc_id, unnest(string_split(issues, ',')) AS issue FROM ({_QUALITY}) WHERE issues <> '') GROUP BY ALL")
def page_issues(t: Tables) -> DataFrame:
    return survey.issue_counts(page_quality(t))


@query("class_summary", f"""SELECT doc_id, verdict AS class, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS percent, string_agg(page_index::VARCHAR, ',' ORDER BY page_index) AS pages
    FROM ({_QUALITY}) WHERE verdict <> 'SKIP' GROUP BY doc_id, verdict""")
def class_summary(t: Tables) -> DataFrame:
    return survey.classes(page_quality(t))


@query("corpus_statistics", f"SELECT doc_id, count(*) AS n_pages, sum(n_words)::BIGINT AS n_words, sum(round(garbage * 1e6)::BIGINT)::BIGINT / count(*) / 1e6 AS garbage, count(*) FILTER (WHERE verdict = 'BAD') AS bad FROM ({_QUALITY}) GROUP BY ROLLUP (doc_id)")
def corpus_statistics(t: Tables) -> DataFrame:
    return survey.corpus_statistics(page_quality(t))


@query("validation_summary", f"""SELECT 'verdict' AS dimension, verdict AS value, count(*) AS n FROM ({_QUALITY}) GROUP BY verdict UNION ALL SELECT 'clean', (issues = '')::VARCHAR, count(*) FROM ({_QUALITY}) GROUP BY issues = ''
    UNION ALL SELECT 'all', '', count(*) FROM ({_QUALITY})""")
def validation_summary(t: Tables) -> DataFrame:
    return survey.summary(page_quality(t))


def _scored(t: Tables) -> DataFrame:
    """Is a document of bad quality by its label, and the share of other characters than letters as its score."""
    n = F.length("text")
    other = F.length(F.regexp_replace("text", "[\\p{L} ]+", ""))
    return t.docs.join(t.table("labels"), "doc_id").where(n > 0).select((other / n).alias("score"), (F.col("quality") == 0).alias("truth"))


_SCORED = "SELECT length(regexp_replace(text, '[\\p{L} ]+', '', 'g')) / length(text) AS score, quality = 0 AS truth FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0"


def _metric_sql(said: str, source: str, key: str = "") -> str:
    return f"""SELECT {key + ',' if key else ''} tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (
        SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r FROM (
        SELECT {key + ',' if key else ''} count(*) FILTER (WHERE {said} AND truth) AS tp, count(*) FILTER (WHERE {said} AND NOT truth) AS fp, count(*) FILTER (WHERE NOT ({said}) AND truth) AS fn,
        count(*) FILTER (WHERE NOT ({said}) AND NOT truth) AS tn FROM ({source}) {'GROUP BY ' + key if key else ''}))"""


@query("confusion_metrics", _metric_sql("score >= 0.1", _SCORED))
def confusion_metrics(t: Tables) -> DataFrame:
    return survey.confusion(_scored(t).select((F.col("score") >= 0.1).alias("said"), "truth"))


@query("threshold_grid", _metric_sql("score >= threshold", f"SELECT * FROM ({_SCORED}), (SELECT unnest(range(1, 11)) / 20 AS threshold)", "threshold"))
def threshold_grid(t: Tables) -> DataFrame:
    grid = t.spark.range(1, 11).select((F.col("id") / 20).alias("threshold"))
    return survey.thresholds(_scored(t), grid)


_RATE = f"SELECT doc_id, page_index, garbage, CASE WHEN garbage * 10 < 0.01 THEN 'A' WHEN garbage * 10 < 0.03 THEN 'B' WHEN garbage * 10 < 0.05 THEN 'C' WHEN garbage * 10 < 0.10 THEN 'D' ELSE 'E' END AS bucket, doc_id || ':' || page_index AS id FROM ({_QUALITY})"


def _bucketed(t: Tables) -> DataFrame:
    return page_quality(t).select("doc_id", "page_index", "garbage", survey.buckets(F.col("garbage") * 10).alias("bucket"), F.concat_ws(":", "doc_id", "page_index").alias("id"))


@query("bucket_counts", f"SELECT bucket, count(*) AS n FROM ({_RATE}) GROUP BY bucket")
def bucket_counts(t: Tables) -> DataFrame:
    return _bucketed(t).groupBy("bucket").agg(F.count("*").alias("n"))


@query("stratified_sample", f"""SELECT doc_id, page_index, garbage, bucket, id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(id), id) AS k, count(*) OVER (PARTITION BY bucket) AS n,
    CASE bucket WHEN 'A' THEN 0.1 WHEN 'B' THEN 0.2 WHEN 'C' THEN 0.5 WHEN 'D' THEN 0.75 ELSE 1.0 END::DOUBLE AS rate FROM ({_RATE})) WHERE k <= greatest(1, floor(n * rate))""")
def stratified_sample(t: Tables) -> DataFrame:
    return survey.stratified(_bucketed(t), "id")


@query("review_batches", f"SELECT doc_id, page_index, bucket, ((row_number() OVER (PARTITION BY bucket ORDER BY id) - 1) // 10 + 1)::INT AS batch FROM ({_RATE})")
def review_batches(t: Tables) -> DataFrame:
    return survey.batches(_bucketed(t), "id", 10, "bucket").select("doc_id", "page_index", "bucket", "batch")


@query("sampled_words", """SELECT doc_id, array_to_string(CASE WHEN len(w) <= 20 THEN w ELSE list_transform(range(20), lambda i: w[floor(i * (len(w) / 20))::BIGINT + 1]) END, ' ') AS words FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents)""")
def sampled_words(t: Tables) -> DataFrame:
    # cut once: items that are an expression would be worked out anew for each one that is taken
    return t.docs.select("doc_id", tx.words(F.col("text")).alias("w")).select("doc_id", F.array_join(survey.evenly(F.col("w"), 20), " ").alias("words"))


@query("percentile_buckets", f"""SELECT doc_id, page_index, CASE WHEN r < 0.5 THEN 'GOOD' WHEN r < 0.75 THEN 'MARGINAL' WHEN r > 0.9 THEN 'REOCR' ELSE 'BAD' END AS bucket FROM (
    SELECT *, percent_rank() OVER (PARTITION BY doc_id ORDER BY garbage) AS r FROM ({_QUALITY}))""")
def percentile_buckets(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    r = F.percent_rank().over(Window.partitionBy("doc_id").orderBy("garbage"))
    return page_quality(t).select("doc_id", "page_index", F.when(r < 0.5, "GOOD").when(r < 0.75, "MARGINAL").when(r > 0.9, "REOCR").otherwise("BAD").alias("bucket"))


def _near(name: str, of: str) -> str:
    return f"SELECT DISTINCT doc_id, page_index + unnest([-1, 0, 1]) AS page_index, '{name}' AS source FROM (SELECT DISTINCT doc_id, page_index FROM ({of}))"


_THREE = {"outline": sq._OUTLINED, "headings": sq._HEADINGS, "contents": sq._RESOLVED}


@query("fusion_agreement", f"""SELECT doc_id, page_index, concat_ws('+', CASE WHEN bool_or(source = 'outline') THEN 'outline' END, CASE WHEN bool_or(source = 'headings') THEN 'headings' END, CASE WHEN bool_or(source = 'contents') THEN 'contents' END) AS agree
    FROM ({' UNION ALL '.join(_near(n, s) for n, s in _THREE.items())}) SEMI JOIN ({' UNION '.join(f'SELECT doc_id, page_index FROM ({s})' for s in _THREE.values())}) e USING (doc_id, page_index) GROUP BY ALL""")
def fusion_agreement(t: Tables) -> DataFrame:
    return survey.agreement(sq.outline_candidates(t), sq.heading_candidates(t), sq.toc_candidates(t))


@query("note_linkage", """SELECT DISTINCT r.doc_id, target_id AS id, 'no content' AS problem FROM d_refs r ANTI JOIN d_notes n ON r.doc_id = n.doc_id AND r.target_id = n.note_id 
    UNION ALL SELECT DISTINCT n.doc_id, note_id, 'no marker' FROM d_notes n ANTI JOIN d_refs r ON r.doc_id = n.doc_id AND r.target_id = n.note_id""")
def note_linkage(t: Tables) -> DataFrame:
    return survey.linkage(t.refs, t.notes)


@query("page_jumps", """SELECT doc_id, page_index, label FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY page_index) AS b FROM (SELECT doc_id, page_index, label, try_cast(label AS INT) AS n FROM (
    SELECT doc_id, page_index, CASE WHEN page_index = 4 THEN '9' ELSE label END AS label FROM d_pages)) WHERE n IS NOT NULL) WHERE b IS NOT NULL AND n <> b + 1 AND n <> 1""")
def page_jumps(t: Tables) -> DataFrame:
    return survey.page_jumps(t.pages.withColumn("label", F.when(F.col("page_index") == 4, "9").otherwise(F.col("label"))))


@query("distinct_pairs", """SELECT seq, wrong, "right" FROM (SELECT *, row_number() OVER (PARTITION BY lower(wrong), lower("right") ORDER BY seq) AS k FROM (
    SELECT doc_id * 100000 + pos AS seq, token AS wrong, word AS "right" FROM d_tokens) WHERE lower(wrong) <> lower("right")) WHERE k = 1""")
def distinct_pairs(t: Tables) -> DataFrame:
    from quire.operators import words

    toks = words.tokens(t.degraded)
    return survey.distinct_pairs(toks.select((F.col("doc_id") * 100000 + F.col("pos")).alias("seq"), F.col("token").alias("wrong"), F.col("word").alias("right")))


@query("distinct_headings", f"""SELECT doc_id, page_index, seq, title, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, lower(substring(title, 1, 30)) ORDER BY seq, source) AS k FROM (
    SELECT doc_id, page_index, seq, title, source FROM ({sq._OUTLINED}) UNION ALL SELECT doc_id, page_index, seq, title, source FROM ({sq._HEADINGS}))) WHERE k = 1""")
def distinct_headings(t: Tables) -> DataFrame:
    both = sq.outline_candidates(t).unionByName(sq.heading_candidates(t).select(st.CANDIDATE))
    return survey.distinct_headings(both).select("doc_id", "page_index", "seq", "title", "source")


_BYTE = "translate({w}, 'äöüßàâçéèêëîïôùûáíóúñ', 'ABCDEFGHIJKLMNOPQRSTU')"
_WORDS = "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents) GROUP BY ALL"


@query("similar_words", f"""SELECT a.doc_id, a.word, b.word AS other, a.n, b.n AS m FROM ({_WORDS}) a JOIN ({_WORDS}) b ON a.doc_id = b.doc_id AND b.n >= 3 AND b.n >= 3 * a.n AND a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 2
    WHERE levenshtein({_BYTE.format(w='a.word')}, {_BYTE.format(w='b.word')}) <= 2""")
def similar_words(t: Tables) -> DataFrame:
    # texts of one document together: its words are counted where they are
    texts = t.table("documents").select("doc_id", "text").repartition("doc_id")
    found = texts.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]+"), F.lit(0))).alias("word"))
    return survey.similar_words(found.groupBy("doc_id", "word").agg(F.count("*").alias("n")))


@query("outline_quality", "SELECT doc_id, count(*) AS n, max(level)::INT AS depth, round(count(DISTINCT o.page_index) / any_value(p.n), 6) AS coverage FROM d_outline o JOIN (SELECT doc_id, count(*) AS n FROM d_pages GROUP BY doc_id) p USING (doc_id) GROUP BY doc_id")
def outline_quality(t: Tables) -> DataFrame:
    return survey.outline_quality(t.outline, t.pages)


def _samples_sql() -> str:
    parts = [f"SELECT doc_id, page_index, text, {k} AS k, '{f}' AS family, '{n}' AS name, regexp_extract(text, '({p})', 1) AS found FROM ({_PAGES}) WHERE regexp_matches(text, '{p}')" for k, (f, n, p) in enumerate(survey.PATTERNS)]
    return f"""SELECT doc_id, page_index, family, name, found, substring(text, greatest(place - 80, 1), place - greatest(place - 80, 1) + length(found) + 80) AS context FROM (
        SELECT *, strpos(text, found) AS place, row_number() OVER (PARTITION BY doc_id, page_index, family ORDER BY k) AS n FROM ({' UNION ALL '.join(parts)})) WHERE n <= 3"""


@query("pattern_samples", _samples_sql())
def pattern_samples(t: Tables) -> DataFrame:
    return survey.samples(_pages(t))


@query("clean_for_embedding", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[0-9]+[ \\t\\n\\r\\f]+', ''), '^[ivxlcIVXLC]+[ \\t\\n\\r\\f]+', ''),
    '^(CHAPTER|INTRODUCTION|PREFACE|INDEX|NOTES|BIBLIOGRAPHY)[ \\t\\n\\r\\f]+', ''), '[¹²³⁰-⁹*†‡]', '', 'g'), '([,.;:])[a-z] ', '\\1 ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS text FROM documents""")
def clean_for_embedding(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", tx.for_embedding(F.col("text")).alias("text"))


@query("roman_numerals", """SELECT word, regexp_matches(word, '^(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$') OR regexp_matches(replace(word, 'l', 'i'), '^(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$') AS roman
    FROM (SELECT DISTINCT word FROM d_tokens WHERE word <> '')""")
def roman_numerals(t: Tables) -> DataFrame:
    from quire.operators import words

    return words.tokens(t.degraded).where("word <> ''").select("word").distinct().withColumn("roman", tx.is_roman(F.col("word")))


@query("word_shapes", f"""SELECT token, regexp_matches(token, '^\\p{{Lu}}[^\\p{{Lu}}]*$') AS capitalized, regexp_matches(token, '\\p{{Lu}}') AND NOT regexp_matches(token, '\\p{{Ll}}') AND length(token) > 1 AS all_caps,
    regexp_matches(token, '({'|'.join(__import__('quire.functions.vocabulary', fromlist=['x']).FOREIGN_ENDINGS)})$') OR (length(token) >= 6 AND contains(token, 'sch')) AS "foreign" FROM (SELECT DISTINCT token FROM d_tokens)""")
def word_shapes(t: Tables) -> DataFrame:
    from quire.operators import words

    w = F.col("token")
    return words.tokens(t.degraded).select("token").distinct().select("token", tx.is_capitalized(w).alias("capitalized"), tx.is_all_caps(w).alias("all_caps"), tx.is_foreign(w).alias("foreign"))


@query("embedding_cosine", "SELECT vec_id, first AS other, round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 6) AS cosine FROM (SELECT *, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings) e JOIN (SELECT vec_id AS first, embedding FROM embeddings) o USING (first)")
def embedding_cosine(t: Tables) -> DataFrame:
    """Every vector against the first one of its label."""
    e = t.table("embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("o")).select("label", F.col("o.vec_id").alias("other"), F.col("o.embedding").alias("theirs"))
    return e.join(first, "label").select("vec_id", "other", F.round(tx.cosine(F.col("embedding"), F.col("theirs")), 6).alias("cosine"))


@query("basic_correction", """SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, 'rn', 'm'), 'cl', 'd'), 'tl', 'ti'), 'Beautlful', 'Beautiful'), 'beautlful', 'beautiful'),
    'rnorning', 'morning'), 'cloing', 'doing'), 'tbat', 'that'), 'wbich', 'which'), 'bave', 'have'), 'judgrnent', 'judgment'), 'judgrment', 'judgment') AS text FROM d_degraded""")
def basic_correction(t: Tables) -> DataFrame:
    return t.degraded.select("doc_id", tx.basic_correction(F.col("text")).alias("text"))
