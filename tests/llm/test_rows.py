"""Operators that judge each row by itself: language ID, quality rules, encoding, licenses, HTML, chat."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, html, language_id, licenses, pieces, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 200_000


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd(spark, extra="language string, kept boolean, ids int, row int, h long"):
    """Nulls, empty, blank, very long and repeated texts, with further columns of clashing names."""
    texts = [None, "", "  \n ", "One two three.", "One two three.", LONG, "日本語 \U0001f600 \x00 ▁ x"]
    data = [(i if i != 2 else None, t, None, None, None, "a", True, 1, 2, 3) for i, t in enumerate(texts)] + [(3, "One two three.", "en", "s", 5, None, None, None, None, None)]
    return spark.createDataFrame(data, f"{SCHEMA}, {extra}")


def test_words_match_the_regular_expression():
    texts = ["Hello, wörld! 12 a_b", "", "  ", "İstanbul ǅ x̂y 日本", "a" * 1000]
    cs, start, end, doc = tokens.word_spans(texts)
    got = [(int(d), "".join(map(chr, cs[s:e]))) for s, e, d in zip(start, end, doc)]
    import regex

    assert got == [(k, w) for k, t in enumerate(texts) for w in regex.findall(r"[\p{L}\p{N}]+", t.lower())]
    h, d = tokens.word_hashes(["same word", "word same"])
    assert h[0] == h[3] and h[1] == h[2] and list(d) == [0, 0, 1, 1]


# -- language ID


def by_hand(text, profiles, size):
    grams = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f" {w} "
        for n in (1, 2, 3):
            grams.update(w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    code = lambda g: sum((ord(c) if c != "\0" else 0) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    top = sorted(grams, key=lambda g: (-grams[g], code(g)))[:size]
    return {lang: sum(abs(k - p.index(code(g))) if code(g) in p else size for k, g in enumerate(top)) / (len(top) * size) for lang, p in profiles.items()}


def test_distances_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = language_id.train(docs, per_language=20, size=60)
    model = language_id.Profiles(profiles, 60)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["a", "Der the la."]
    got, _ = model.distances(texts)
    for text, row in zip(texts, got):
        want = by_hand(text, profiles, 60)
        assert np.allclose(row, [want[x] for x in model.langs])


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    profiles = language_id.train(docs.where("doc_id % 2 = 0"))
    found = language_id.identify(docs.where("doc_id % 2 = 1"), profiles).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    assert found.where("n_chars >= 100").agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).collect()[0][0] > 0.97
    assert found.where("n_chars >= 100").agg(F.avg(F.col("accepted").cast("int"))).collect()[0][0] > 0.99


def test_texts_of_no_learned_language_are_rejected(spark, sf_dir):
    """Spanish is unlabelled here; the letters of other texts are shuffled; short texts of learned languages stay."""
    import corpus_pipeline

    rng = random.Random(3)
    table = [tuple(r) for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    own = [r for r in table if r[2] != "es"]
    spanish = [(10_000 + r[0], r[1], None, None, None) for r in table if r[2] == "es"]
    mixed = [(20_000 + r[0], "".join(rng.sample(r[1], len(r[1]))), None, None, None) for r in own[:200] if len(r[1]) > 200]
    short = [(30_000 + r[0], r[1][: r[1].find(" ", 100)], None, None, None) for r in own[:200] if len(r[1]) > 200]
    docs = spark.createDataFrame([*own, *spanish, *mixed, *short], SCHEMA)
    kept = Counter(r.doc_id // 10_000 for r in corpus_pipeline.keep_known_languages(spark, docs, "").select("doc_id").collect())
    assert kept[1] <= 0.05 * len(spanish) and kept[2] <= 0.05 * len(mixed)
    assert kept[0] >= 0.99 * len(own) and kept[3] >= 0.9 * len(short)
    assert language_id.learn_bound(docs.where("false")) == language_id.MAX_DISTANCE


def test_bound_and_profiles_are_of_all_labelled_rows(spark):
    """More rows than any number of documents picked by doc_id, some without one, against brute force."""
    rng, size = random.Random(5), 60
    letters = {"en": "etaoinshrd", "fr": "esaitnrulo"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7)))
    table = [(k if k % 5 else None, " ".join(word(lang) for _ in range(rng.randint(3, 25))), lang, None, None) for k in range(1300) for lang in ("en" if k % 9 else "fr",)]
    docs = spark.createDataFrame(table + [(9, None, "en", None, None), (10, "quite other words", None, None, None)], SCHEMA)

    def top(lang, of):
        grams = Counter()
        for _, text, own, _, _ in table:
            for w in re.findall(r"[a-z]+", text if own == lang and of(text) else ""):
                grams.update(f" {w} "[i : i + n] for n in (1, 2, 3) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n] != " ")
        count = {sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)): n for g, n in grams.items()}
        return sorted(count, key=lambda g: (-count[g], g))[:size]

    half = {r.text: r.half for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()}
    profiles = [{lang: top(lang, lambda x: half[x] == k) for lang in letters} for k in (0, 1)]
    far = {lang: [round(by_hand(x, profiles[1 - half[x]], size)[lang], 6) for _, x, own, _, _ in table if own == lang] for lang in letters}
    want = max(np.quantile(x, language_id.OWN_QUANTILE) for x in far.values()) + language_id.OWN_SLACK
    assert abs(language_id.learn_bound(docs, size=size, max_distance=2.0) - want) < 1e-6
    assert language_id.train(docs, size=size) == {lang: top(lang, lambda x: True) for lang in letters}


def test_language_edge_cases(spark):
    profiles = {"en": [ord(c) for c in "etao"], "xx": [ord(c) for c in "zq"]}
    got = language_id.identify(odd(spark), profiles).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].language == by[1].language == "und" and by[0].distance is None and not by[0].accepted
    assert by[3].language == "en"
    assert {r.language for r in language_id.identify(odd(spark), {}).collect()} == {"und"}
    assert language_id.train(odd(spark).where("false")) == {}
    assert language_id.identify(odd(spark).where("false"), profiles).count() == 0
    kept = language_id.accepted_documents(odd(spark), profiles, max_distance=1.0)
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} <= {3, 4, 5, 6}


# -- quality rules


def test_quality_rules(spark):
    clean = "The cat and the dog are in the house, and it is good for the children who play on the grass. " * 2
    data = {1: clean, 2: None, 3: "", 4: "a | b | c | d | e | f | g | h | i | j | k | l", 5: "AND THE CAT SAT ON THE MAT WITH A HAT OF RED", 6: "the the the the the cat cat cat cat cat", 7: LONG}
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(k, t, "x", 1) for k, t in data.items()], "doc_id long, text string, words string, kept int")).collect()}
    assert got[1].kept and got[1].broken == ""
    assert got[2].broken == got[3].broken == "few_words" and got[2].n_words == 0
    assert "bars" in got[4].broken and "capitals" in got[5].broken and "stuttering" in got[6].broken and "stuttering" in got[7].broken
    assert quality.judge(odd(spark)).count() == 8 and quality.judge(odd(spark).where("false")).count() == 0


def test_quality_bounds_are_kept_and_labels_are_met(spark, sf_dir):
    rule = (quality.Rule("few", "n_words", least=3),)
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string"), rule).collect()}
    assert got == {1: True, 2: False}
    d = sf_dir.replace("sf0.001", "sf0.01")
    table = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    counts = {(r.quality, r.kept): r.n for r in table.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert counts.get((1, False), 0) <= 3 and counts.get((0, True), 0) <= 5


# -- SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def test_ids_equal_those_of_merging_by_score(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    parts = ["th", "in ", " ", "er", "ation", "     ", "----", "\n\n", "é", "über", "1234", "  if", "(x)", "日本", "\U0001f600", "a", "b"]
    texts = ["", " ", "a  b", "a" * 37, " " * 45 + "x", "\x00"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    ids, count = model.encode(texts)
    ends = np.cumsum(count)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, count)] == sp.encode(texts)
    assert model.decode(ids, count) == texts


def test_pairs_match_brute_force(model):
    """A pair stands iff merging the two pieces' text in order of score gives the two."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = np.random.default_rng(1)
    a, b = (rng.choice(model.number, 2000) for _ in "ab")
    names = [sp.id_to_piece(int(i)) for i in model.ids]

    def merge(text):
        parts = list(text)
        rank = {names[k]: k for k in model.number}
        while True:
            best = min(((rank.get(x + y, 1 << 40), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    got = model.apart(a, b)
    for x, y, ok in list(zip(a, b, got))[:150]:
        assert ok == (merge(names[x] + names[y]) == [names[x], names[y]])
    assert (model.apart(a, b) == model._derive(a, b)).all()


def test_encoding_edge_cases(spark):
    got = pieces.encode(odd(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[0].ids is None and by[0].n_tokens == 0 and by[0].exact is None and by[1].ids == [] and by[1].exact
    assert all(r.exact for r in got if r.doc_id != 0) and by[5].n_tokens > 100_000
    assert pieces.encode(odd(spark).where("false")).count() == 0


def test_decoding_is_the_inverse(spark):
    df = odd(spark, "x string, kept boolean, n int, row int, h long")
    got = pieces.decode(pieces.encode(df).withColumn("text", F.lit("clash")))
    assert rows(got) == rows(df.select("doc_id", "text"))
    lost = spark.createDataFrame([(1, [40_000, -1, None]), (2, []), (3, None)], "doc_id long, ids array<long>")
    assert rows(pieces.decode(lost)) == [(1, ""), (2, ""), (3, None)]
    assert pieces.decode(pieces.encode(df.where("false"))).count() == 0


def test_models_of_another_kind_are_refused(tmp_path):
    """The kind is a number in the file; a unigram model differs in it."""
    data = open(pieces.MODEL, "rb").read()
    spec = next(v for k, v in pieces._fields(data) if k == 2)
    assert dict(pieces._fields(spec))[3] == 2
    at = data.index(spec) + spec.index(b"\x18\x02")
    (tmp_path / "other.model").write_bytes(data[: at + 1] + b"\x01" + data[at + 2 :])
    with pytest.raises(ValueError):
        pieces.load(str(tmp_path / "other.model"))


# -- licenses


def test_statistics_match_brute_force():
    rng = random.Random(0)
    for _ in range(50):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 8))] for _ in range(3)]
        automaton, q = licenses.Automaton(seqs), [rng.randint(0, 3) for _ in range(20)]
        for i, (v, n) in enumerate(automaton.statistics(q)):
            assert n == max(m for m in range(i + 2) if m == 0 or any(s[j : j + m] == q[i + 1 - m : i + 1] for s in seqs for j in range(len(s) - m + 1)))
            if n:
                assert automaton.ends[v] == {(k, j) for k, s in enumerate(seqs) for j in range(n - 1, len(s)) if s[j + 1 - n : j + 1] == q[i + 1 - n : i + 1]}


def best_chain(matches, gap):
    """Most covered tokens of any chain, by trying all."""

    def after(last, rest):
        out = 0
        for k, (d, t, n) in enumerate(rest):
            gain = n
            if last:
                e, u, m = last
                gain = n - max(0, e + m - d, u + m - t)
                if gain <= 0 or d <= e or t <= u or d - e - m > gap or t - u - m > gap:
                    continue
            out = max(out, gain + after((d, t, n), rest[k + 1 :]))
        return out

    return after(None, sorted(matches))


def test_chains_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        matches = list({(rng.randint(0, 30), rng.randint(0, 30), rng.randint(1, 6)) for _ in range(rng.randint(0, 8))})
        got = licenses.chains(matches, 3)
        assert (got[0][0] if got else 0) == best_chain(matches, 3)
        assert len({m for _, c in got for m in c}) == sum(len(c) for _, c in got)


def test_tails_of_cut_chains_stay():
    matches = [(0, 0, 10), (11, 11, 6), (13, 10, 3), (17, 14, 3)]
    assert {m for _, c in licenses.chains(matches, 3) for m in c} == set(matches)


def test_spans_match_brute_force():
    """Each template's best chain by trying all, and no span that a better one overlaps."""
    rng = random.Random(21)
    letters = "abcdef"
    for _ in range(60):
        templates = tuple((f"T{k}", " ".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))) for k in range(2))
        scanner = licenses.Scanner(templates, least=2, gap=2, coverage=0.6)
        text = [rng.choice(letters + "z") for _ in range(10)]
        at = rng.randint(0, 10)
        text[at:at] = templates[0][1].split()
        best = {}
        for k, (_, template) in enumerate(templates):
            t = template.split()
            same = lambda i, j, n: 0 <= i and 0 <= j and i + n <= len(text) and j + n <= len(t) and text[i : i + n] == t[j : j + n]
            # the longest matches with any template that end at each word and can't go on as long
            whole = [x.split() for _, x in templates]
            longest = [max(n for n in range(i + 2) if n == 0 or any(x[j : j + n] == text[i + 1 - n : i + 1] for x in whole for j in range(len(x)))) for i in range(len(text))] + [0]
            found = [(i + 1 - n, j, n) for i, n in enumerate(longest[:-1]) if n >= 2 and longest[i + 1] <= n for j in range(len(t)) if same(i + 1 - n, j, n)]
            covered = best_chain(found, 2)
            if covered >= 0.6 * len(t):
                best[k] = covered
        got = scanner.scan([" ".join(text)])[0]
        assert max((c for *_, c in got), default=0) == max(best.values(), default=0)
        assert all(a[2] < b[1] for a, b in zip(got, got[1:])) and all(c >= 0.6 * len(scanner.sequences[k]) for k, _, _, c in got)


def test_templates_of_a_table(spark):
    whole = " ".join(f"term{k}" for k in range(3000))
    table = spark.createDataFrame([("Own", whole, 1), ("Own", whole, 2), (None, "x", 1), ("Null", None, 1)], "license string, text string, template int")
    templates = licenses.templates_of(table)
    assert templates == (("Own", whole),)
    docs = spark.createDataFrame([(1, "before " + whole + " after"), (2, " ".join(whole.split()[:1000])), (3, whole.replace("term7 ", "other "))], "doc_id long, text string")
    assert rows(licenses.scan(docs, templates).select("doc_id", "license", "first_word", "n_words")) == [(1, "Own", 1, 3000), (3, "Own", 0, 2999)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(licenses, "MOST_TOKENS", 100)
        with pytest.raises(ValueError):
            licenses.templates_of(table)


def test_license_spans(spark):
    mit = licenses.TEMPLATES[0][1]
    data = [(1, "Intro words. " + mit.replace("obtaining", "getting") + " End.", 7), (2, "Released under the MIT License. Released under the MIT License.", 7), (3, "No terms of the kind here, and the software is good.", 7)]
    got = rows(licenses.scan(spark.createDataFrame(data, "doc_id long, text string, license int")).select("doc_id", "license", "first_word", "n_words"))
    assert got == [(1, "MIT", 2, 162), (2, "MIT", 0, 5), (2, "MIT", 5, 5)]
    assert licenses.scan(odd(spark)).count() == 0 and licenses.scan(odd(spark).where("false")).count() == 0
    assert licenses.scan(spark.createDataFrame([(None, LONG + mit)], "doc_id long, text string")).count() == 1


# -- HTML


def test_html_content(spark):
    words = "this paragraph has many words and hardly any tags in it " * 4
    nav = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12))
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><ul>{nav}</ul><script>if (a < b) x('</p>')</script><p>{words}</p><p>{words} &amp; more<br>{words}</p><ul>{nav}</ul></body></html>"
    text, kept, n = html.content(page)
    assert "link 5" not in text and "many words" in text and "& more" in text and "x(" not in text and kept < n
    data = [(1, page), (1, page), (2, None), (3, ""), (4, "plain text"), (5, "<p>" * 3000 + "deep"), (None, "<b>x</b>"), (6, "<div><!-- a --><script>x</script></div>"), (7, "<p>" + words * 20_000)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame([(*d, "u", "t") for d in data], "page_id long, html string, url string, text string")).collect()}
    assert got[2].text is None and got[3].text == "" and got[4].text == "plain text" and got[6].text == "" and "deep" in got[5].text and got[None].text == "x"
    assert len(got[7].text) > 1_000_000
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("junk", ["<![foo bar]>", "<![%foo[", "<![CDATA[ x > y ]]>", "<![if !IE]>", "<![endif]>", "<!foo", "<?x", "</", "<", "&#" + "9" * 5000 + ";", "<![", "<!-", "<!", "<a\x00b>", "]]>", "<![CDATA["])
def test_odd_markup_is_no_error(junk):
    text, kept, n = html.content(f"<p>before</p>{junk}<p>after</p>")
    assert "before" in text and "after" in text and " y " not in text
    html.content(junk)
    html.content(junk * 50)


@pytest.mark.parametrize("junk", ["<a", "<!--", "<!--a>", "<!--a> b", "<![CDATA[", "<![cdata[>", "</a", "<svg></p>", "<svg>", "</svg>", "<script>", "<a href='", "<a x=\"", "<?", "<![x", "&#", "& ", "<", "<a ", "<!", "<p ", "<li>x", "--", "<a x=/", "</ "])
def test_time_grows_with_the_page(junk):
    """1 MB of things that never end, or that end once, at the very end."""
    import time

    page = junk * (1_000_000 // len(junk))
    for more in ("", ">", "-->", "\"'>"):
        began = time.process_time()
        html.content("<p>text</p>" + page + more)
        assert time.process_time() - began < 8


def test_content_matches_brute_force():
    """Pages made of lines with known text and tags: ratios, smoothing, threshold and choice by plain Python."""
    rng = random.Random(4)
    for _ in range(60):
        page, known = "", []
        for _ in range(rng.randint(1, 25)):
            words = " ".join(rng.choice(["a", "word", "longer"]) for _ in range(rng.choice([0, 1, 2, 30])))
            inner = rng.randint(0, 4)
            page += "<p>" + f"<b>{words}</b>" * (inner > 0) + "<i></i>" * max(0, inner - 1) + words * (inner == 0) + "</p>\n"
            known.append((words, 2 + 2 * inner))
        size = [len(w) for w, _ in known]
        ratio = [len(w) / n for w, n in known]
        kernel = lambda d: np.exp(-0.5 * (d / html.SIGMA) ** 2) if abs(d) <= html.REACH * html.SIGMA else 0.0
        smooth = [sum(kernel(i - j) * r for j, r in enumerate(ratio)) / sum(kernel(i - j) for j in range(len(ratio))) for i in range(len(ratio))]
        mean = sum(smooth) / len(smooth)
        bound = html.THRESHOLD * (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5
        if any(abs(x - bound) < 1e-9 for x in smooth) and len(known) > 1:
            continue
        want = [w for (w, _), x, s in zip(known, smooth, size) if s and (len(known) == 1 or x >= bound)]
        assert html.content(page) == ("\n".join(want), len(want), len(known))


def test_smoothing_matches_its_definition():
    x = np.array([1.0, 5.0, 2.0, 8.0])
    w = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    want = [sum(w[j - i + 3] * x[j] for j in range(4)) / sum(w[j - i + 3] for j in range(4)) for i in range(4)]
    assert np.allclose(html.smoothed(x, 1.0), want)


def test_html_recovers_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = [(r.html, r.text) for r in html.extract(pages).join(pages, "page_id").collect()]
    both = own = there = 0
    for page, text in got:
        inside = re.search(r"<article>(.*?)</article>", page, re.S)
        truth = Counter(re.sub(r"<[^>]+>", " ", inside[1]).split()) if inside else Counter()
        found = Counter(text.split())
        both, own, there = both + sum((truth & found).values()), own + sum(found.values()), there + sum(truth.values())
    assert both / own > 0.9 and both / there > 0.9


# -- chat


def test_roles_of_held_out_conversations(spark, sf_dir):
    c = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/conversations.parquet")
    model, test = chat.train(c.where("conv_id % 2 = 0")), c.where("conv_id % 2 = 1")
    truth = chat._turns(test).select("conv_id", F.array_join("turns.role", ",").alias("truth"))
    got = chat.parse(chat.transcripts(test), model).join(truth, "conv_id")
    assert got.agg(F.avg((F.col("roles") == F.col("truth")).cast("int"))).collect()[0][0] > 0.95


def test_viterbi_matches_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    model = chat.Model()
    model.start, model.move = rng.random(6), rng.random((6, 6))
    model.emit = [rng.random((6, s)) for s in model.SIZES]
    model.finish()
    seen = [np.stack([rng.integers(0, s, n) for s in model.SIZES], 1) for n in (0, 1, 4, 2, 4)]
    for x, path in zip(seen, model.viterbi(seen)):
        def score(p):
            return sum(sum(t[s, v] for t, v in zip(model.emit, row)) for s, row in zip(p, x)) + (model.start[p[0]] if len(p) else 0) + sum(model.move[a, b] for a, b in zip(p, p[1:]))

        best = max(itertools.product(range(6), repeat=len(x)), key=score)
        assert np.isclose(score(best), score(tuple(path))) if len(x) else len(path) == 0


def test_the_canonical_form_can_be_read_again():
    rng = random.Random(5)
    parts = ["<|end|>", "<|user|>", "\n", "\\", "<", "|", "<\\|end|>", "x", "<|system|>\n", "|>"]
    for _ in range(500):
        turns = [(rng.choice(chat.ROLES), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        assert chat.turns_of(chat.canonical(turns)) == turns


def test_transcripts_of_other_sources(spark, sf_dir):
    """Texts that weren't rendered from the table, in forms and languages of their own."""
    model = chat.train(spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/conversations.parquet"))
    texts = [
        "### Human: How do I sort a list in Python?\n### Assistant: Use sorted().\n```python\nsorted([3, 1])\n```\n### Human: And backwards?\n### Assistant: Pass reverse=True.",
        "<|user|>\nWo ist der Bahnhof?\n<|assistant|>\nGleich dort.\n",
        "Q: What is two plus two, and why is it so?\nA: It is four, as anybody can count with fingers.\nQ: Sure?\nA: Yes, it is.",
    ]
    got = {r.conv_id: r for r in chat.parse(spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string"), model).collect()}
    assert got[0].roles == "user,assistant,user,assistant" and got[1].roles == "user,assistant" and got[2].roles == "user,assistant,user,assistant"
    assert chat.turns_of(got[0].formatted)[1] == ("assistant", "Use sorted().\n```python\nsorted([3, 1])\n```")


def test_chat_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, style int, turns string"
    data = [(1, 0, "user", "Hi\n\nthere?", 9, "x"), (1, 1, "assistant", "Yes.", 9, "x"), (1, 1, "assistant", "Yes.", 9, "x"), (2, None, None, None, 9, "x"), (None, 0, "user", "q", 9, "x"), (3, 0, "user", LONG, 9, "x")]
    c = spark.createDataFrame(data, schema)
    lone = c.unionByName(spark.createDataFrame([(None, 0, "user", "q", 9, "x"), (None, 1, "user", "r", 9, "x")], schema))
    assert chat.transcripts(lone).where("conv_id IS NULL").count() == 3  # each its own
    got = {r.conv_id: r for r in chat.parse(chat.transcripts(c), chat.train(c)).collect()}
    assert set(got) == {1, 2, 3, None} and got[1].n_turns == 3 and got[1].roles == "user,assistant,assistant" and got[2].n_turns == 0
    assert got[1].formatted.startswith("<|user|>\nHi\n\nthere?\n<|end|>\n<|assistant|>\nYes.")
    plain = chat.parse(spark.createDataFrame([(1, None), (2, ""), (3, "just a line")], "conv_id long, text string"), chat.train(c.where("false"))).collect()
    assert [r.roles for r in sorted(plain)][:2] == [None, ""]
    assert chat.parse(chat.transcripts(c.where("false")), chat.train(c)).count() == 0
