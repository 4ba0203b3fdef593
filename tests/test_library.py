"""Small cases of the library's operators, and properties of those that fold or cut."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.errors import BadSettings, QuireError
from quire.functions import text as tx
from quire.functions import vocabulary
from quire.operators import chunks, correction, spans, structure, survey, words
from quire.plans.convert import convert
from quire.settings import Conversion, Reading
from quire.sources import export, files, layout
from quire.streaming import ingest

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


# -- spans and chunks


@FEW
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=6))
def test_paragraphs_are_what_blank_lines_part(spark, texts):
    got = spans.paragraph_spans(docs_of(spark, *texts)).collect()
    for r in got:
        assert texts[r.doc_id][r.start : r.end] == r.text and r.text and "\n\n" not in r.text
    import re

    for k, t in enumerate(texts):
        assert [r.text for r in sorted(got, key=lambda r: r.start) if r.doc_id == k] == [p for p in re.split(r"\n\n+", t) if p]


@FEW
@given(st.lists(st.integers(0, 90), min_size=1, max_size=6), st.integers(0, 15))
def test_fixed_chunks_equal_the_loop(spark, sizes, overlap):
    texts = ["".join(chr(97 + i % 26) for i in range(n)) for n in sizes]
    got = sorted(tuple(r) for r in chunks.fixed_size(docs_of(spark, *texts), 4, overlap).select("doc_id", "chunk_index", "start", "end", "text").collect())
    want = []
    for d, t in enumerate(texts):
        at = k = 0
        while at < len(t):
            end = min(at + 16, len(t))
            want.append((d, k, at, end, t[at:end]))
            at, k = (end - overlap if end < len(t) else end), k + 1
    assert got == want


def test_overlap_has_to_be_shorter(spark):
    with pytest.raises(ValueError):
        chunks.fixed_size(docs_of(spark, "x"), 4, 16)
    with pytest.raises(ValueError):
        chunks.to_chunks("words", docs_of(spark, "x"), None, None)


@FEW
@given(st.lists(st.lists(st.integers(1, 30), max_size=8), min_size=1, max_size=4))
def test_packed_chunks_equal_the_loop(spark, sizes):
    texts = ["\n\n".join(chr(97 + k) * n for k, n in enumerate(s)) for s in sizes]
    got = {(r.doc_id, r.chunk_index): (r.start, r.end, r.text) for r in chunks.semantic(docs_of(spark, *texts), 10, 5).collect()}
    for d, t in enumerate(texts):
        current, start, k, at = "", 0, 0, 0
        for p in [p for p in t.split("\n\n") if p]:
            at = t.index(p, at)
            if len(current) + len(p) > 40 and current:
                assert got.pop((d, k)) == (start, at, current)
                k, start = k + 1, max(0, at - 5)
                current = t[start:at]
            current += p
        if current:
            assert got.pop((d, k)) == (start, len(t), current)
    assert not got


def test_lookups(spark):
    pages = spark.createDataFrame([(1, 0, "i", 0, 10), (1, 1, "ii", 12, 20)], "doc_id long, page_index long, label string, start long, end long")
    points = spark.createDataFrame([(1, "a", 0), (1, "b", 10), (1, "c", 19), (2, "d", 0)], "doc_id long, k string, position long")
    assert {(r.k, r.label) for r in spans.page_for_position(points, pages, ["k"]).collect()} == {("a", "i"), ("c", "ii")}
    sections = spark.createDataFrame([(1, 0, 1, "A", 0, 20), (1, 1, 2, "B", 5, 20), (1, 2, 2, "C", 5, 20)], "doc_id long, seq long, level int, title string, start long, end long")
    assert [r.title for r in spans.section_for_position(points.where("k = 'c'"), sections, ["k"]).collect()] == ["B"]
    ranges = spark.createDataFrame([(1, 6, 8), (1, 20, 30)], "doc_id long, from_pos long, to_pos long")
    assert [r.title for r in spans.section_for_range(ranges, sections, ["doc_id", "from_pos"]).collect()] == ["A"]


def test_lookups_are_equi_joins(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = spans.page_spans(layout.pages(docs))
    found = spans.page_for_position(layout.references(docs).select("doc_id", "k", "position"), placed, ["doc_id", "k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_two_columns_and_push_filters(spark, sf_dir):
    plan = chunks.fixed_size(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id > 5"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "GreaterThan(doc_id,5)" in plan and "Exchange" not in plan


def test_citation(spark):
    of = lambda a, t, p: one(spark, chunks.citation(F.col("a"), F.col("t"), F.col("p")), a=a, t=t, p=p)
    assert of("Kay", "Title", "64,65") == "Kay, Title, p. 64-65"
    assert of(None, "Title", "64") == "Title, p. 64" and of("Kay", None, None) == "p. ?" and of("", "", "") == "p. ?"


# -- words


LEX = ["temporal", "occur", "stop", "known", "word", "cognition", "experience", "the", "read", "phenomenon", "philosophy", "light"]


@pytest.fixture(scope="module")
def lex(spark):
    return spark.createDataFrame([(w, 5, 10 * (k + 1), 4.0) for k, w in enumerate(LEX)], "word string, doc_freq long, freq long, zipf double").cache()


def test_word_validity(spark, lex):
    got = {r.word: r for r in words.judge(spark.createDataFrame([(w,) for w in ["known", "cognitions", "occurring", "stopped", "unknown", "temporalizes", "xqz", "aaab", "mands", "zebra"]], "word string"), lex).collect()}
    assert got["known"].confidence == 1.0 and got["known"].valid
    assert got["cognitions"].morphology == 0.9 and got["occurring"].morphology == pytest.approx(0.765) and got["stopped"].morphology == pytest.approx(0.765)
    assert got["unknown"].morphology == 0.8 and got["temporalizes"].valid and not got["zebra"].valid
    assert got["xqz"].pattern == 0.2 and got["aaab"].pattern == 0.0 and got["mands"].morphology == 0.0


def test_detection_modes(spark, lex):
    texts = docs_of(spark, "The known cognitions of Dasein xyzzq a!", None, "")
    new = {r.word: r.status for r in words.detect(words.tokens(texts), lex).collect()}
    assert new == {"the": "valid", "known": "valid", "cognitions": "error", "of": "error", "dasein": "scholarly", "xyzzq": "error", "a": "short"}
    old = {r.word: r.status for r in words.detect(words.tokens(texts), lex, "legacy", more=("xyzzq",)).collect()}
    assert old["cognitions"] == "valid" and old["xyzzq"] == "scholarly"
    with pytest.raises(ValueError):
        words.detect(words.tokens(texts), lex, "other")


def test_line_breaks(spark, lex):
    text = "pheno-\nmenon and philo-\n  sophy, meta-\n123 self-\nevident; a pheno-menon."
    judged = words.judge_breaks(words.break_candidates(docs_of(spark, text)), lex)
    assert {r.joined: r.should_join for r in judged.collect()} == {"phenomenon": True, "philosophy": True, "meta123": False, "selfevident": False}
    at_ends = words.apply_breaks(docs_of(spark, text, "no hyphen"), judged).collect()
    assert {r.doc_id: r.text for r in at_ends} == {0: "phenomenon and philosophy, meta-\n123 self-\nevident; a pheno-menon.", 1: "no hyphen"}
    assert "a phenomenon." in words.apply_breaks(docs_of(spark, text), judged, everywhere=True).first().text
    long = words.judge_breaks(words.break_candidates(docs_of(spark, "a" * 20 + "-\n" + "b" * 20)), lex).first()
    assert long.reason == "length" and long.confidence == 0.0
    learned = words.learn(words.judge_breaks(words.break_candidates(docs_of(spark, "cogni-\ntions cogni-\ntions")), lex), lex).first()
    assert learned.word == "cognitions" and learned.occurrences == 2 and learned.confidence == pytest.approx(0.9)


def test_nfc(spark):
    assert one(spark, tx.nfc(F.col("x")), x="é") == "é"


def test_scholarly_terms():
    assert len(vocabulary.DETECTION) == 153 and "dasein" in vocabulary.DETECTION and len(vocabulary.MISREADINGS) == 13


# -- structure


SECTION = "doc_id long, seq int, start long, end long, title string, level int, confidence double, source string"


def test_validators(spark):
    s = spark.createDataFrame([(1, 0, 0, 150, "One", 1, 0.9, "x"), (1, 1, 100, 200, "Two", 1, 0.9, "x"), (1, 2, 200, 250, "12", 3, 0.9, "x"), (1, 3, 250, 500, "n" * 201, 3, 0.9, "x"), (1, 4, 500, 900, "123", 3, 0.9, "x")], SECTION)
    got = {(r.type, r.severity, r.seq) for r in structure.validate(s).collect()}
    assert got == {("overlap", "warning", 0), ("hierarchy_skip", "info", 2), ("short_section", "info", 2), ("short_title", "info", 2), ("long_title", "warning", 3), ("numeric_title", "info", 4)}
    assert structure.structure_confidence(s, structure.validate(s)).first().confidence == pytest.approx(0.9 - 2 * 0.05 - 4 * 0.02)
    own = lambda x: x.select("doc_id", F.lit("own").alias("type"), F.lit("info").alias("severity"), "seq", "title")
    assert structure.validate(s, [own]).count() == 5


def test_titles_are_enriched_by_the_likest_entry(spark):
    c = spark.createDataFrame([(1, "outline", 0, 0, "Introductlon", 1, 0.95, 3), (1, "outline", 1, 9, "Far", 1, 0.95, 9)], "doc_id long, source string, seq int, start long, title string, level int, confidence double, page_index long")
    t = spark.createDataFrame([(1, 0, "Introduction", 4), (1, 1, "Introductions", 3), (1, 2, "Far", 3)], "doc_id long, seq int, title string, page_index long")
    assert [r.title for r in structure.enrich_titles(c, t).orderBy("seq").collect()] == ["Introduction", "Far"]


def test_document_types(spark):
    ind = spark.createDataFrame([(1, 200, True, False, False, True), (2, 10, False, True, False, False), (3, 45, False, False, False, False), (4, 45, True, False, True, False), (5, 10, False, False, False, False)], "doc_id long, n_pages long, has_contents boolean, has_abstract boolean, has_numbers boolean, has_outline boolean")
    assert {r.doc_id: r.type for r in structure.type_scores(ind).collect()} == {1: "book", 2: "article", 3: "generic", 4: "report", 5: "article"}
    assert {r.doc_id: r.type for r in structure.builder_type(ind).collect()} == {1: "book", 2: "article", 3: "generic", 4: "generic", 5: "article"}


# -- correction


def test_known_patterns(spark):
    of = lambda x: one(spark, correction.known_patterns(F.col("x")), x=x)
    assert of("Tbe cat and tbe tbe dog") == "The cat and the the dog" and of("rnorning, Wonld") == "morning, Would"
    assert of("a bro- ken word") == "a broken word" and of("shares tbex") == "shares tbex"


def test_quality(spark):
    got = {r.doc_id: r for r in correction.quality(docs_of(spark, "All fine words here.", "tbe d1gits w|rong ,,", "", None)).collect()}
    assert got[0].score == 1.0 and got[0].usable and not got[0].needs_correction
    assert got[1].correctable == 1 and got[1].digits_in_words == 1 and got[1].bar_in_word == 1 and got[1].needs_correction
    assert got[2].score == got[3].score == 0.0 and got[2].error_rate == 1.0
    seen = []
    correction.quality(docs_of(spark, "x"), seen.append)
    assert len(seen) == 1


def test_corrections(spark, lex):
    got = {r.word: (r.suggestion, r.distance) for r in correction.corrections(spark.createDataFrame([("knwon",), ("lihgt",), ("wird",), ("qqqqqqq",), ("word",)], "word string"), lex).collect()}
    assert got == {"knwon": ("known", 2), "lihgt": ("light", 2), "wird": ("word", 1)}
    text = correction.spelled(docs_of(spark, "The wotd, (WOTD) Wotd!\nis lihgt"), lex).first()
    assert text.text == "The word, (WORD) Wotd! is light" and text.n_changed == 3
    strict = correction.corrected(docs_of(spark, "a wotd lihgt"), lex, correction.Settings.conservative()).first()
    assert strict.text == "a word lihgt" and strict.n_applied == 1
    whole = correction.correct(docs_of(spark, "tbe wotd"), lex).first()
    assert whole.text == "the word" and whole.confidence == 0.7
    kept = correction.correct(docs_of(spark, "only fine wotd words are here"), lex, least_score=0.8).first()
    assert kept.text == "only fine wotd words are here"


def test_settings_are_checked():
    for bad in (lambda: correction.Settings(apply=0.2), lambda: correction.Settings(most_edits=0), lambda: Conversion(on_error="x"), lambda: Reading(least_confidence=2), lambda: Reading(least_length=0), lambda: Conversion(page_markers="x")):
        with pytest.raises(ValueError):
            bad()
    assert issubclass(BadSettings, QuireError)


# -- survey


def test_samples_are_exact(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 50, "A").when(F.col("id") < 99, "C").otherwise("B").alias("bucket"))
    assert {r.bucket: r.n for r in survey.stratified(rows, "id").groupBy("bucket").agg(F.count("*").alias("n")).collect()} == {"A": 5, "C": 24, "B": 1}


def test_confusion_without_positives(spark):
    r = survey.confusion(spark.createDataFrame([(False, False)], "said boolean, truth boolean")).first()
    assert (r.tn, r.precision, r.recall, r.f1, r.accuracy) == (1, 0.0, 0.0, 0.0, 1.0)


# -- files, exports, conversion, streams


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Title\nText")
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "in/c").write_bytes(b"%PDF-1.4")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.format) for r in files.read(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": ("ok", "markdown"), "b.pdf": ("failed", "pdf"), "c": ("failed", "pdf")}
    assert files.read(spark, str(tmp_path / "in"), "skip").count() == 1
    with pytest.raises(Exception, match="no parser"):
        files.read(spark, str(tmp_path / "in"), "raise").collect()
    files.register("pdf", lambda b: [{"text": " one "}, {"text": "two", "label": "x"}])
    try:
        assert [(r.label, r.text) for r in files.read(spark, str(tmp_path / "in")).where("path LIKE '%b.pdf'").orderBy("page_index").collect()] == [("1", "one"), ("x", "two")]
    finally:
        del files.PARSERS["pdf"]


def test_convert_save_and_load(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = convert(layout.pages(docs), layout.blocks(docs), layout.outline(docs), words.lexicon(docs), Conversion(reading=Reading(enabled=True), use_profiles=True))
    files.save(out, str(tmp_path))
    back = files.load(spark, str(tmp_path), out)
    assert back["documents"].count() == docs.count() and back["pages"].count() == layout.pages(docs).count()
    assert {k: v.columns for k, v in back.items()} == {k: v.columns for k, v in out.items()}
    files.save_learned(out["learned"], str(tmp_path / "lex"))
    assert files.load_learned(spark, str(tmp_path / "lex")).count() == out["learned"].count() and files.load_learned(spark, str(tmp_path / "none")).count() == 0


def test_json_keeps_what_it_is_given(spark):
    rows = files.from_json(spark.createDataFrame([(json.dumps({"doc_id": 1, "text": "x"}),), ("{broken",)], "json string")).collect()
    assert (rows[0].doc_id, rows[0].text, rows[0].pages, rows[0].version) == (1, "x", [], "1.0") and rows[1].doc_id is None


def test_classifications_of_any_shape(spark):
    page = {"page_number": 3, "classification": "good", "confidence": 0.9}
    shapes = [[page], {"pages": [page]}, {"classifications": [page]}, {"classified_pages": [{"page_num": 3, "verdict": "Good", "confidence": 0.9}]}]
    rows = files.classifications(spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(shapes)], "batch int, json string")).collect()
    assert [(r.page_number, r.classification, r.confidence) for r in rows] == [(3, "GOOD", 0.9)] * 4


def test_deep_contents(spark):
    o = spark.createDataFrame([(1, k, lv, f"t{k}") for k, lv in enumerate([1, 2, 3, 2, 1, 3])], "doc_id long, seq int, level int, title string")
    paths = {r.seq: (r.depth, r.path) for r in export.contents_paths(export.contents_tree(o)).collect()}
    assert paths == {0: (0, "0"), 1: (1, "0/1"), 2: (2, "0/1/2"), 3: (1, "0/3"), 4: (0, "4"), 5: (1, "4/5")}


def test_streams(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.documents(spark, str(tmp_path / "in"), files_at_once=1)
    ingest.write(ingest.chunked(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == chunks.fixed_size(docs).count()
    seen = []
    ingest.each_batch(ingest.scored(stream), lambda df, k: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert len(seen) == 3 and sum(seen) == docs.count()
    old = spark.createDataFrame([("a", 2, 0.5, "x"), ("b", 1, 0.4, "y")], "word string, occurrences long, confidence double, contexts string")
    merged = {r.word: (r.occurrences, round(r.confidence, 6)) for r in ingest.merge_learned(old, old.where("word = 'a'")).collect()}
    assert merged == {"a": (4, 0.7), "b": (1, 0.4)}


# -- error rates


def edits_by_table(x, y):
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
    return row[-1]


def test_edits_equal_the_table():
    import random

    from quire.operators import detectors

    rng = random.Random(6)
    for _ in range(400):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert detectors.edits(x, y) == edits_by_table(x, y)
        assert detectors.edits(x.split("a"), y.split("a")) == edits_by_table(x.split("a"), y.split("a"))
        near = "".join(c if rng.random() > 0.05 else rng.choice(["", "z", c + "y"]) for c in x)
        assert detectors.edits(x, near) == edits_by_table(x, near)
        assert detectors._few_edits(x, y, 200) == edits_by_table(x, y)


def test_error_rates_read_whole_texts(spark, tmp_path):
    """The only damage comes after the first 200 characters."""
    from quire.plans import library
    from quire.sources import layout

    texts = ["xx " * 100 + "on the other side, we sit on the ice.\n" * 3, "plain", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    damaged = {r.doc_id: r.text for r in layout.degraded(docs).collect()}
    assert damaged[0] != texts[0] and damaged[0][:200] == texts[0][:200]

    def aligned(a, b):
        return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))

    for name, by_hand, cut in (("word_error_rate", edits_by_table, lambda x: x.lower().split()), ("character_error_rate", edits_by_table, str.lower), ("aligned_error_rate", aligned, str)):
        got = {r.doc_id: r.rate for r in library.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {k: round(by_hand(cut(x), cut(damaged[k])) / max(1, len(cut(x))), 6) for k, x in enumerate(texts)} and got[0] > 0


# -- words that are near each other


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_similar_words_equal_brute_force_and_meet_in_place(spark):
    words_of = {1: {"seinen": 9, "seinem": 3, "sinen": 2, "meinem": 1, "x": 4, "y": 1, "straße": 6, "strasse": 2, "q" * 40: 5, "q" * 38: 1}, 2: {"seinem": 1, "abcdef": 3, "abcfed": 1, "": 1}}
    rows = [(d, w, n) for d, ws in words_of.items() for w, n in ws.items()] + [(None, "seinem", 1), (None, "seinen", 9)]
    got = survey.similar_words(spark.createDataFrame(rows, "doc_id long, word string, n long"))
    want = {(d, a, b, n, m) for d, ws in words_of.items() for a, n in ws.items() for b, m in ws.items() if a != b and m >= 3 and m >= 3 * n and edits(a, b) <= 2}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert exchanges(got) <= 2  # the counts by document; forms of words are not shuffled


def test_capitals_are_those_of_sql(spark):
    import duckdb

    odd = [c for c in map(chr, range(32, 0x2FFFF)) if len(c.upper()) > 1] + ["straße", "abc", "é"]
    rows = spark.createDataFrame([(k, "a" + w) for k, w in enumerate(odd)], "k int, w string").select("k", tx.upper(F.col("w")).alias("u")).collect()
    assert {r.k: r.u for r in rows} == {k: duckdb.execute("SELECT upper(?)", ["a" + w]).fetchone()[0] for k, w in enumerate(odd)}
    lex = spark.createDataFrame([("straße", 9, 9, 1.0)], "word string, doc_freq long, freq long, zipf double")
    assert correction.spelled(docs_of(spark, "(STRASE) strase Strase,"), lex).first().text == "(STRAẞE) straße Strase,"


def test_forms_of_the_lexicon_are_not_broadcast(spark):
    lex = spark.createDataFrame([("word", 9, 9, 1.0)], "word string, doc_freq long, freq long, zipf double")
    words_of = spark.createDataFrame([("wrod",), ("ward",)], "word string")
    found = correction.corrections(words_of, lex)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [form" in plan and "BroadcastHashJoin [form" not in plan
    assert sorted((r.word, r.distance) for r in found.collect()) == [("ward", 1), ("wrod", 2)]


def test_corrected_texts_stay_whole(spark):
    lex = spark.createDataFrame([("silver", 9, 9, 3.0)], "word string, doc_freq long, freq long, zipf double")
    docs = docs_of(spark, "silvr\n and «silvr», SILVR x", " \n", "none here", None)
    got = {r.doc_id: (r.text, r.n_changed) for r in correction.spelled(docs, lex).collect()}
    assert got == {0: ("silver and «silver», SILVER x", 3), 2: ("none here", 0)}
    got = {r.doc_id: (r.text, r.n_changed, r.n_applied, r.n_review + r.n_skipped) for r in correction.corrected(docs, lex).collect()}
    assert got == {0: ("silver and «silver», SILVER x", 3, 3, 0), 2: ("none here", 0, 0, 0)}


# -- words are read once


@pytest.mark.parametrize(("mode", "sure"), [("new", False), ("legacy", False), ("new", True)])
def test_statistics_of_texts_are_those_of_their_tokens(spark, mode, sure):
    docs = docs_of(spark, "tbe dasein aeb's --", "", " '\n' ", "ΑΣ. ΑΣ a\u0301É e\u0301 \u0301x 'ae' ba eb eb a-e b'", "1 _ a\x0bb a\x85e")
    lex = spark.createDataFrame([("a", 9), ("ae", 9), ("aeb's", 5)], "word string, freq long")
    learned = spark.createDataFrame([("eb", 0.9), ("ba", 0.1)], "word string, confidence double") if sure else None
    want = words.statistics(words.detect(words.tokens(docs), lex, mode, learned=learned))
    got = words.text_statistics(docs, lex, mode, learned=learned)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    if not sure:
        errors = words.detect(words.tokens(docs), lex, mode).where("status = 'error'")
        assert sorted(map(tuple, words.errors(docs, lex, mode).collect())) == sorted(map(tuple, errors.select("doc_id", "pos", "token", "word", "confidence").collect()))


def test_words_are_judged_in_one_pass(spark, tmp_path):
    docs_of(spark, "walking talks").write.parquet(f"{tmp_path}/docs")
    docs, lex = spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame([("walk", 9)], "word string, freq long")
    judged = words.judge(words.tokens(docs), lex)
    assert judged._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r.word: (r.known, r.morphology) for r in judged.collect()} == {"walking": (False, 0.85), "talks": (False, 0.0)}
    counted = words.lexicon(docs, 1)
    assert {r.word: r.freq for r in counted.collect()} == {"walking": 1, "talks": 1}


def test_pages_are_cut_in_place_and_worked_out_once(spark, tmp_path):
    from pyspark.sql import Window

    from quire.plans import survey_queries
    from quire.plans.registry import Tables

    texts = ["", "\n", "a", *("\n".join(f"l{k}" for k in range(n)) + end for n in (7, 8, 9, 16, 17) for end in ("", "\n", "\n\n"))]
    docs_of(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    pages = survey_queries._pages(Tables(spark, str(tmp_path)))
    want = [(d, k // 8, "\n".join(t.split("\n")[k : k + 8])) for d, t in enumerate(texts) for k in range(0, len(t.split("\n")), 8)]
    assert sorted(map(tuple, pages.collect())) == want
    classes = survey.classes(survey.page_quality(pages))
    plan = classes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|!1l") == 1  # the filter on verdicts has no copy of the patterns


def test_looks_of_words_are_counted(spark):
    import re

    text = "the bcd aei aaaab aab bbbbx xyzzzzy rhythm dasein nous ab abé tt_t aaaa 3abc queue"
    alpha = re.findall(r"(?<!\w)[a-z]{3,}(?!\w)", text)
    good = [w for w in alpha if re.search("[aeiou]", w) and re.search("[b-df-hj-np-tv-z]", w) and not re.search(r"(.)\1{3}", w)]
    n, bad = tx.word_counts(F.col("x"))
    r = spark.createDataFrame([(text,)], "x string").select(n.alias("n"), bad.alias("bad")).first()
    assert (r.n, r.n - r.bad) == (len(alpha), len(good))


def test_evidence_is_searched_once_and_words_are_cut_once(spark, sf_dir):
    from quire.operators import detectors
    from quire.plans import survey_queries
    from quire.plans.registry import Tables

    notes = docs_of(spark, 'x"\'b → c', "seen: tbe → the", "'a-'->\"b\"", "none", "seen: — → x", "a-b->c-d")
    got = {r.doc_id: (r.wrong, r.right) for r in detectors.error_pairs(notes, F.col("text")).collect()}
    old = "[\"']?([\\p{L}\\p{N}_'-]+)[\"']?[ \\t]*(?:→|->)[ \\t]*[\"']?([\\p{L}\\p{N}_'-]+)"
    rows = notes.select("doc_id", *[F.regexp_extract("text", old, k) for k in (1, 2)]).collect()
    assert got == {d: (a, b) for d, a, b in rows if a}
    plan = survey_queries.sampled_words(Tables(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_conversion_reads_its_repaired_texts_from_a_table(spark):
    docs = docs_of(spark, "a walk-\ning man\n" * 3, "walk man", "walk a man")
    lex = spark.createDataFrame([(w, 9, 9, 3.0) for w in ("walk", "man")], "word string, doc_freq long, freq long, zipf double")
    tables = convert(layout.pages(docs), layout.blocks(docs), layout.outline(docs), lex)
    plan = tables["quality"]._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # line breaks aren't looked for again
    assert {r.doc_id: r.text for r in tables["documents"].collect()}[0].count("walking") == 3
