"""Operators that compare rows: line dedup, decontamination, the Jaccard join, toxicity, and the pipeline."""

from __future__ import annotations

import random
from collections import Counter
from math import ceil

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontaminate, jaccard_join, line_dedup, queries, toxicity
from quire.runtime import shared_dir, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 100_000


def docs_of(spark, data, more=""):
    return spark.createDataFrame(data, f"doc_id long, text string{more}")


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def invented(rng, n, size=400):
    return " ".join(f"w{int(rng.random() ** 2 * size)}" for _ in range(n))


def near(rng, text, change):
    return " ".join(w if rng.random() > change else f"z{rng.randint(0, 10**6)}" for w in text.split())


# -- line dedup


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    data = [(k, "\n".join(f"  Line {int(rng.random() ** 2 * 12)} " if rng.random() < 0.8 else "" for _ in range(rng.randint(0, 9)))) for k in range(60)]
    norm = lambda x: " ".join(x.lower().split(" ")).strip()
    norm = lambda x: regex.sub(r"[ \t\r\f]+", " ", x.lower()).strip(" ")
    count = Counter(h for _, t in data for h in {norm(x) for x in t.split("\n")} if h)
    want = {k: "\n".join(x for x in t.split("\n") if count[norm(x)] <= 10) for k, t in data}
    got = {r.doc_id: r.text for r in line_dedup.drop_common_lines(docs_of(spark, data), 10).collect()}
    assert got == want and any(want[k] != t for k, t in data)


def test_line_edge_cases(spark):
    data = [(k, "Shared\nown %d" % k, "c", 1, 2) for k in range(3)] + [(0, "Shared\nown 0", "c", 1, 2), (7, None, None, None, None), (8, "", None, None, None), (None, "shared\nx", None, None, None), (9, LONG, "", 0, 0)]
    df = docs_of(spark, data, ", id string, line int, n_lines int")
    got = line_dedup.drop_common_lines(df, 2).collect()
    assert len(got) == len(data)
    text = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got}
    assert text[1] == ("own 1", 2, 1) and text[7] == (None, 0, 0) and text[8] == ("", 1, 0) and text[None] == ("x", 2, 1) and text[9][0] == LONG
    several = [(None, "shared\nx"), (None, "shared\ny"), (None, "z"), (None, "z"), (None, None)]
    assert sorted(map(str, (r.text for r in line_dedup.cut_common_lines(df.select("doc_id", "text").unionByName(docs_of(spark, several)), 2).where("doc_id IS NULL").collect()))) == ["None", "x", "x", "y", "z", "z"]
    assert {r.doc_id: r.text for r in line_dedup.drop_common_lines(df, 3).collect()}[1] == "Shared\nown 1"  # a tie with the threshold stays
    assert line_dedup.drop_common_lines(df.where("false")).count() == 0


# -- decontamination


def shingles(w, n=3):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def leaks_by_hand(data, bench, share):
    out = {}
    for d, text in data:
        ds = shingles(words(text))
        for i, item in bench:
            its = shingles(words(item))
            if not its:
                continue
            s = set(its)
            best = max((len(s & set(ds[p : p + len(its)])) for p in range(len(ds))), default=0)
            if best >= ceil(share * len(s) - 1e-9):
                out[d, i] = max(out.get((d, i), 0), round(best / len(s), 6))
    return out


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0])
def test_leaks_against_brute_force(spark, share):
    rng = random.Random(7)
    bench = [(k, invented(rng, rng.randint(1, 40), 60)) for k in range(12)]
    data = []
    for k in range(60):
        text = invented(rng, rng.randint(0, 80), 60)
        if k % 2:
            text += " " + near(rng, rng.choice(bench)[1], rng.choice([0, 0.05, 0.2])) + " " + invented(rng, 20, 60)
        data.append((k, text))
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.leaks(docs_of(spark, data), items, containment=share).collect()}
    assert got == leaks_by_hand(data, bench, share) and got


def test_leak_edge_cases(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", 5), (2, None, 5), (3, "", 5), (4, "two words", 5), (None, "alpha beta gamma", 5), (1, "alpha beta gamma delta epsilon", 5)], "item_id long, text string, h int")
    data = [(1, "x alpha beta gamma delta epsilon y", 1), (1, "x alpha beta gamma delta epsilon y", 1), (2, None, 1), (3, "", 1), (None, "alpha beta gamma delta epsilon", 1), (5, LONG + "alpha beta gamma delta epsilon", 1)]
    df = docs_of(spark, data, ", size int")
    want = {(1, 1, 1.0), (5, 1, 1.0)}
    assert {tuple(r) for r in decontaminate.leaks(df, items).collect()} == want
    named = decontaminate.leaks(df.selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS pos"), items.selectExpr("concat('i', item_id) AS item_id", "text", "1 AS width"))
    assert {tuple(r) for r in named.collect()} == {("d1", "i1", 1.0), ("d5", "i1", 1.0)}
    assert decontaminate.leaks(df.where("false"), items).count() == 0 and decontaminate.leaks(df, items.where("false")).count() == 0


@pytest.mark.parametrize("bits", [8, 26])
def test_a_full_filter_changes_no_result(spark, monkeypatch, bits):
    """With 256 bits nearly every shingle passes the filters; the joins still decide on whole hashes."""
    monkeypatch.setattr(decontaminate, "FILTER", bits)
    rng = random.Random(3)
    bench = [(k, invented(rng, rng.randint(1, 60), 200)) for k in range(20)]
    data = [(k, invented(rng, 30, 200) + " " + near(rng, rng.choice(bench)[1], 0.1) + " " + invented(rng, 60, 200)) for k in range(40)]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.leaks(docs_of(spark, data), items).collect()}
    assert got == leaks_by_hand(data, bench, decontaminate.CONTAINMENT) and got


def test_bounds_leave_fewer_pairs_than_the_prefix(spark):
    """Prefixes hold the rarest shingles; hits without enough of the item around them are no candidates, and none that leaks is lost."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(6)]
    bench = [(k, " ".join(rng.choice(common) for _ in range(30)) + f" x{k} y{k} z{k} " + " ".join(rng.choice(common) for _ in range(30))) for k in range(8)]
    data = [(k, bench[k % 8][1] if k % 3 == 0 else " ".join(rng.choice(common) for _ in range(50)) + f" x{k % 8} y{k % 8} z{k % 8} " + " ".join(f"o{k}{j}" for j in range(80))) for k in range(48)]
    docs, items = docs_of(spark, data), spark.createDataFrame(bench, "item_id long, text string")
    ranked, known = decontaminate.ranked_items(docs, items, containment=0.9)
    df = Counter(g for _, t in data for g in set(shingles(words(t))))
    for r in ranked.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "df"))).alias("ranks")).collect():
        own = sorted(df[g] for g in set(shingles(words(dict(bench)[r.item_id]))))
        assert [x.df for x in r.ranks] == own and [x.rank for x in r.ranks] == list(range(1, len(own) + 1))
    found, pairs = decontaminate.candidates(docs, ranked, known, 3)
    pairs = {(r.doc_id, r.item_id) for r in pairs.collect()}
    leaked = set(leaks_by_hand(data, bench, 0.9))
    assert leaked <= pairs and leaked and len(pairs) < found.count()


def test_windows_match_brute_force():
    import numpy as np

    rng = np.random.default_rng(5)
    rows = sorted((int(g), int(p), int(h)) for g, p, h in zip(rng.integers(0, 20, 400), rng.integers(0, 90, 400), rng.integers(0, 12, 400)))
    rows = [r for k, r in enumerate(rows) if k == 0 or r[:2] != rows[k - 1][:2]]
    group, pos, h = (np.array(c) for c in zip(*rows))
    width = np.array([3, 10, 40])[group % 3]
    first, most = decontaminate.most_held(group, pos, h, width)
    for f, m in zip(first, most):
        own = [(p, x) for g, p, x in rows if g == group[f]]
        assert m == max(len({x for p, x in own if q <= p < q + width[f]}) for q, _ in own)


# -- Jaccard join


def sets(text):
    w = words(text)
    return set(shingles(w)) or ({tuple(w)} if w else set())


def classes_by_hand(data, threshold=jaccard_join.THRESHOLD):
    """doc_id: (class_id, n_links, n_copies), and the number of links between different sets; data: one text for each id."""
    of = {d: frozenset(sets(t)) for d, t in data}
    docs = Counter(s for s in of.values() if s)
    kinds = list(docs)
    like = {(x, y) for x in kinds for y in kinds if x != y and len(x & y) >= threshold * len(x | y)}
    links = Counter(x for x, _ in like)
    head = {d: d for d in of}
    while True:
        least = {}
        for d, s in of.items():
            least[s] = min(least.get(s, d), head[d]) if s else d
        new = {d: min([head[d], least[s], *(least[y] for x, y in like if x == s)]) if s else d for d, s in of.items()}
        if new == head:
            return {d: (head[d], links[s], docs[s] - 1 if s else 0) for d, s in of.items()}, len(like) // 2
        head = new


def joined(df, **more):
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_join.jaccard_join(df, **more).collect()}


def test_recall_and_precision_of_the_join(spark):
    rng = random.Random(11)
    data = []
    for k in range(120):
        base = invented(rng, rng.randint(1, 60), 3000)
        data += [(len(data) + j, near(rng, base, c)) for j, c in enumerate([0, 0.02, 0.05, 0.08, 0.12][: rng.randint(1, 5)])]
    of = {d: sets(t) for d, t in data}
    df = docs_of(spark, data)
    signed = jaccard_join.signatures(df)
    node = {r.node: r.doc_id for r in signed.collect()}
    pairs = {tuple(sorted((node[r.a], node[r.b]))): r.jaccard for r in jaccard_join.similar_sets(df, signed).collect()}
    truth = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a in node.values() for b in node.values() if a < b and of[a] & of[b]}
    truth = {p: j for p, j in truth.items() if j >= jaccard_join.THRESHOLD}
    assert set(pairs) <= set(truth) and all(abs(pairs[p] - truth[p]) < 1e-12 for p in pairs)
    assert len(pairs) >= 0.9 * len(truth) > 50
    got, (want, n) = joined(df), classes_by_hand(data)
    assert set(got) == set(want) and all(got[d][2] == want[d][2] and got[d][1] <= want[d][1] for d in got)
    assert sum(x[1] for x in got.values()) >= 0.9 * sum(x[1] for x in want.values())
    assert sum(got[d][0] == want[d][0] for d in got) >= 0.95 * len(want)


def test_a_large_group_is_joined_whole(spark, monkeypatch):
    """No link of a group is lost when its bucket can't be split, and copies add no rows."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rng = random.Random(1)
    base = invented(rng, 80, 5000)
    data = [(k, near(rng, base, 0.02)) for k in range(60)] + [(100 + k, base) for k in range(3)]
    got, (want, n) = joined(docs_of(spark, data), bucket=5, levels=2), classes_by_hand(data)
    assert got == want and n > 100 and {x[0] for x in got.values()} == {0}


def test_join_edge_cases(spark):
    data = [(1, "a b c d e", 1), (2, "A b, c d e!", 1), (2, "A b, c d e!", 1), (3, None, 1), (4, "", 1), (None, "a b c d e", 1), (5, "one", 1), (6, "One.", 1), (7, LONG, 1), (8, LONG, 1), (9, "!!", 1)]
    df = docs_of(spark, data, ", node int")
    want = {1: (1, 0, 1), 2: (1, 0, 1), 3: (3, 0, 0), 4: (4, 0, 0), 5: (5, 0, 1), 6: (5, 0, 1), 7: (7, 0, 1), 8: (7, 0, 1), 9: (9, 0, 0)}
    assert joined(df) == want
    heads = {r.doc_id: r.head for r in jaccard_join.group_heads(df).collect()}
    assert heads == {1: 1, 2: 1, 5: 5, 6: 5, 7: 7, 8: 7, 4: 4, 9: 4}  # texts without a word are one group
    assert jaccard_join.jaccard_join(df.where("false")).count() == 0 and jaccard_join.group_heads(df.where("false")).count() == 0
    named = df.selectExpr("concat('d', doc_id) AS doc_id", "text", "node AS label", "node AS class_id", "node AS sig")
    assert joined(named) == {f"d{d}": (f"d{c}", n, m) for d, (c, n, m) in want.items()}
    assert {r.doc_id: r.head for r in jaccard_join.group_heads(named).collect()} == {f"d{d}": f"d{h}" for d, h in heads.items()}
    several = docs_of(spark, [(1, "a b c d e"), (1, "p q r s t"), (2, "A B C D E"), (3, "p q r s t"), (4, "p q r s t u")])
    assert joined(several) == {1: (1, 1, 1), 2: (1, 0, 1), 3: (1, 1, 1), 4: (1, 1, 0)}


def test_components_of_any_shape(spark):
    rng = random.Random(6)
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 50)]
    loose = [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)]
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    edges = [*chain, *star, *loose, (5, 5), (1001, 1000)]
    for a, b in edges:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_heads_are_connected_components(spark):
    rng = random.Random(4)
    data, text = [], [f"q{k}" for k in range(40)]
    for k in range(12):  # a chain: neighbours are alike, the ends are not
        data.append((50 - k, " ".join(text)))
        text = text[4:] + [f"r{k}{j}" for j in range(4)]
    data += [(100 + k, invented(rng, 30, 9000)) for k in range(5)]
    heads = {r.doc_id: r.head for r in jaccard_join.group_heads(docs_of(spark, data)).collect()}
    assert heads == {50 - k: 39 for k in range(12)}


# -- toxicity


def toxic_corpus(rng, n=1500):
    bad, common = [f"bad{k}" for k in range(12)], [f"c{k}" for k in range(1500)]
    data, labels = [], []
    for k in range(n):
        w, toxic = [rng.choice(common) for _ in range(40)], k % 8 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        data.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    copy = " ".join([f"copied{k}" for k in range(40)] + bad[:2])
    data += [(n + k, copy) for k in range(30)] + [(n + 100 + k, " ".join([rng.choice(common) for _ in range(40)] + [f"copied{k}"])) for k in range(30)]
    labels += [(n + k, 1) for k in range(30)]
    return data, labels


def test_held_out_toxicity(spark):
    data, labels = toxic_corpus(random.Random(2))
    half = [x for x in labels if x[0] % 2]
    half += [(d, t) for d, t in labels if d % 16 == 0]  # the toxic ones are all even
    found = {r.doc_id: r.toxic for r in toxicity.score(docs_of(spark, data), spark.createDataFrame(half, "doc_id long, toxic int")).collect()}
    seen = {d for d, _ in half}
    rest = [(d, t) for d, t in labels if d not in seen]
    assert all(found[d] for d, t in rest if t) and any(t for _, t in rest)
    assert sum(found[d] for d, t in rest if not t) == 0
    assert not any(found[d] for d, _ in data if d >= 1600)  # words of copied toxic documents aren't toxic


@pytest.mark.parametrize("copies", [0, 400])
def test_copies_neither_lift_nor_sink_words(spark, copies):
    """A toxic text that holds all bad words, and many copies of it, leave the verdicts on all other documents as they are."""
    data, labels = toxic_corpus(random.Random(2))
    data += [(5000 + k, "start " + " ".join(f"bad{j} own{j}" for j in range(12))) for k in range(copies)]
    labels += [(5000 + k, 1) for k in range(copies)]
    found = {r.doc_id: r.toxic for r in toxicity.score(docs_of(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    rest = [(d, t) for d, t in labels if d < 1500]
    assert sum(found[d] for d, t in rest if t) >= 0.95 * sum(t for _, t in rest) and sum(found[d] for d, t in rest if not t) == 0
    assert not any(found[d] for d, _ in data if 1600 <= d < 5000)


def scores_by_hand(data, labels):
    """Seeds, tied words, edges, walks and scores without Spark; equal texts are copies."""
    import numpy as np
    from quire.llm import tokens

    t = toxicity
    vocabulary = sorted({w for _, x in data for w in words(x)})
    code = dict(zip(vocabulary, map(int, tokens.word_hashes(vocabulary)[0])))
    texts = {x: {code[w] for w in words(x)} for _, x in data}
    label = {}
    for d, y in labels:
        label[dict(data)[d]] = max(y, label.get(dict(data)[d], 0))
    share = sum(label.values()) / len(label)
    n = Counter(w for x in label for w in texts[x])
    a = Counter(w for x, y in label.items() if y for w in texts[x])
    z = lambda hits, n, p: (hits - n * p) / max(n * p * (1 - p), 1e-9) ** 0.5
    toxic = {w for w in n if z(a[w], n[w], share) >= t.DEVIATIONS and a[w] >= t.LEAST_DOCS and a[w] >= t.PURITY * n[w]}
    most = max(n[w] for w in toxic)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    clean = sorted((w for w in n if z(a[w], n[w], share) <= 0 and n[w] <= most), key=lambda w: (z(a[w], n[w], share), signed(w)))[: len(toxic)]
    df, near = Counter(), Counter()
    for own in texts.values():
        df.update(own)
        near.update(own if own & toxic else ())
    q = sum(bool(own & toxic) for own in texts.values()) / len(texts)
    tied = {w for w in df if near[w] >= t.LEAST_DOCS and near[w] >= t.PURITY * df[w] and z(near[w], df[w], q) >= t.DEVIATIONS and not (n[w] >= t.EVIDENCE and a[w] < t.PURITY * n[w])}
    nodes = sorted(toxic | set(clean) | tied)
    both = Counter((i, j) for own in texts.values() for i in own & set(nodes) for j in own & set(nodes) if i != j)
    w = np.zeros((len(nodes), len(nodes)))
    for i, x in enumerate(nodes):
        edges = sorted((-(np.log(both[x, y] * len(texts) / (df[x] * df[y])) - t.SHIFT), j) for j, y in enumerate(nodes) if both[x, y])
        for far, j in [e for e in edges if e[0] < 0][: t.NEIGHBOURS]:
            w[i, j] -= far
            w[j, i] -= far
    degree = w.sum(1)
    move = np.divide(w, np.sqrt(np.outer(degree, degree)), out=np.zeros_like(w), where=w > 0)
    met = []
    for start in (toxic, set(clean)):
        home = np.array([x in start for x in nodes]) / len(start)
        p = home
        for _ in range(t.STEPS):
            p = (1 - t.RESTART) * move.T @ p + t.RESTART * home
        met.append(p)
    polarity = {x: u / (u + v) if u + v else 0.5 for x, u, v in zip(nodes, *met)}
    assert tied - toxic
    return {d: sum(2 * polarity[x] - 1 for x in texts[text] if polarity.get(x, 0) >= t.POLARITY) for d, text in data}


def test_scores_match_brute_force(spark):
    rng = random.Random(12)
    data, labels = toxic_corpus(rng, 700)
    data = [(d, x + " tied" + str(d % 3) if d % 8 == 0 and d < 700 else x) for d, x in data]  # words of unlabelled toxic documents
    half = [x for x in labels if x[0] % 16 or x[0] >= 700]
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, data), spark.createDataFrame(half, "doc_id long, toxic int")).collect()}
    want = scores_by_hand(data, half)
    assert set(got) == set(want) and all(abs(got[d] - want[d]) < 1e-5 for d in want) and sum(x >= toxicity.TOXIC for x in want.values()) > 50


def test_a_word_of_few_documents_counts_at_any_size(spark):
    """The evidence that makes a word toxic is the same in a corpus ten times as large."""
    rng = random.Random(13)
    common = [f"c{k}" for k in range(1500)]
    data = [(k, " ".join(rng.choice(common) for _ in range(30)) + " slur" * (k % 12 == 0)) for k in range(240)]
    labels = [(k, int(k % 12 == 0)) for k in range(200)]
    for more in (0, 20_000):
        rows = data + [(1000 + k, " ".join(rng.choice(common) for _ in range(10))) for k in range(more)]
        found = {r.doc_id for r in toxicity.score(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).where("toxic").collect()}
        assert found == {k for k in range(240) if k % 12 == 0}


def test_texts_that_share_a_notice_count_each(spark, monkeypatch):
    """A long notice makes no copies of different texts. All labels are read, and neither a full filter nor fewer words in the scan change a score."""
    rng = random.Random(1)
    common, notice = [f"c{k}" for k in range(1500)], " ".join(f"notice{k}" for k in range(400))
    data = [(k, f"{notice} " + " ".join(rng.choice(common) for _ in range(30)) + " slur" * (k % 12 == 0)) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 12 == 0)) for k in range(200)], "doc_id long, toxic int")
    scores = lambda: {r.doc_id: (r.score, r.toxic) for r in toxicity.score(docs_of(spark, data), labels).collect()}
    found = scores()
    assert {d for d, (_, toxic) in found.items() if toxic} == {k for k in range(240) if k % 12 == 0}
    monkeypatch.setattr(toxicity, "LABELLED", 20, raising=False)  # the bound on labels that there was
    monkeypatch.setattr(decontaminate, "FILTER", 6)
    monkeypatch.setattr(toxicity, "COMMON", 1)
    assert scores() == found


def test_walk_matches_matrix_powers():
    import numpy as np

    rng = np.random.default_rng(0)
    w = np.triu(rng.random((6, 6)) * (rng.random((6, 6)) < 0.6), 1)
    w += w.T
    a, b = np.nonzero(w)
    start = np.array([1.0, 1, 0, 0, 0, 0])
    d = w.sum(0)
    t = np.divide(w, np.sqrt(np.outer(d, d)), out=np.zeros_like(w), where=w > 0)
    p = start / 2
    for _ in range(toxicity.STEPS):
        p = 0.85 * t.T @ p + 0.15 * start / 2
    assert np.allclose(toxicity.walk(a, b, w[a, b], start), p)


def test_toxicity_edge_cases(spark):
    df = docs_of(spark, [(1, "a b", 1), (1, "a b", 1), (2, None, 1), (3, "", 1), (None, "x", 1), (4, LONG, 1)], ", words int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    for marks in (labels, labels.where("false")):
        got = toxicity.score(df, marks).collect()
        assert len(got) == 6 and all(r.score == 0 and not r.toxic for r in got)
    assert toxicity.score(df.where("false"), labels).count() == 0


# -- the pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    """On clean English-like texts: common lines go, one of each group stays, leaks go, ids decode."""
    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    base = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    extra = [(10_000 + k, base[k][1], base[k][2], "s", 0) for k in range(5)] + [(11_000, base[3][1] + "\n" + bench[0][1], base[3][2], "s", 0), (None, base[0][1], None, None, None), (12_000, None, None, None, None), (12_001, "123 456", "en", "s", 7)]
    table = spark.createDataFrame(base + extra, SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, step = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, kept, str(tmp_path)), name.replace(" ", "-"))
        step.append(out)
        if len(step) < 5:
            assert out.schema == table.schema
            kept = out
    language, lines, groups, clean, ids = ([tuple(r) for r in s.collect()] for s in step)
    assert {12_000, 12_001}.isdisjoint({r[0] for r in language}) and len(language) >= len(base)
    # line dedup
    norm = lambda x: regex.sub(r"[ \t\r\f]+", " ", x.lower()).strip(" ")
    count = Counter(h for _, h in {(r[0], norm(x)) for r in language if r[0] is not None for x in r[1].split("\n")} if h)
    want = Counter((r[0], "\n".join(x for x in r[1].split("\n") if count[norm(x)] <= line_dedup.MAX_DOCS)) for r in language)
    assert Counter((r[0], r[1]) for r in lines) == want and all(len(r[1]) == r[4] for r in lines)
    # one of each group: no two of the kept are alike, and all that went are alike to one that stays or went
    of = {r[0]: sets(r[1]) for r in lines if r[0] is not None}
    like = lambda a, b: len(of[a] & of[b]) >= jaccard_join.THRESHOLD * len(of[a] | of[b])
    stay = {r[0] for r in groups if r[0] is not None}
    gone = set(of) - stay
    assert gone and all(any(like(g, o) for o in of if o != g) for g in gone)
    assert not [(a, b) for a in stay for b in stay if a < b and like(a, b)]
    assert all(o in stay for o in of if not any(like(o, p) for p in of if p != o))
    # leaks
    found = leaks_by_hand([(r[0], r[1]) for r in groups if r[0] is not None], bench, decontaminate.CONTAINMENT)
    assert {r[0] for r in clean} == {r[0] for r in groups} - {d for d, _ in found}
    assert Counter(r[0] for r in ids) == Counter(r[0] for r in clean) and all(r[3] for r in ids)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, step[-1].collect()))


def test_pipeline_of_clashing_columns_and_empty_tables(spark, tmp_path):
    """Further columns with names that the stages use stay until the last stage; empty tables give no rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    clash = ["n_lines", "n_dropped", "head", "node", "id", "row", "line", "kept", "drop", "leaks", "item_id", "a.b", "h", "language", "ids"]
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for step, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, str(tmp_path)), "clash")
        assert kept.columns == docs.columns and kept.where("n_lines <> 0 OR `a.b` <> 11").isEmpty()
    bench.where("false").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).count() == docs.count()
    docs.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_and_shared_folder(spark):
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 11)]
    assert shared_dir(spark) == shared_dir(spark)
