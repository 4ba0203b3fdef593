"""Toxicity by an induced lexicon: random walks from labelled seed words over a graph of words.

Seeds are words that the labelled documents tie to one side beyond chance. The graph's nodes are the seeds and the words whose
documents, labelled or not, mostly hold a toxic seed besides them, unless the labelled ones that hold them are mostly
clean. How many documents of the whole corpus hold a word plays no part: a word counts on the evidence of LEAST_DOCS
documents, whatever the corpus' size, and a common word goes because its labels say so. The graph's edges
join every node to the nodes with the greatest positive pointwise mutual information of being in one document, counted
over all documents. Two random walks, which restart at the toxic and at the clean seeds, meet each node with a
probability each; the share of the first is the word's polarity.

In all counts the copies of a document, which have the same words in the same order, are one. Every other document counts, every labelled
one too. Counts stay in distributed tables: the driver gets the seeds, the tied words and their edges, each of which passed the
tests, a filter of one size, and up to COMMON words that the scan may leave out, since a join leaves out all their like.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import decontaminate, tokens
from quire.runtime import prepare, written

#: A toxic seed is over-represented by so many standard deviations among the toxic ones of the labelled documents, of which it
#: takes at least so many and of its own at least this share. For a further node the same holds of documents with a toxic seed.
DEVIATIONS, LEAST_DOCS, PURITY = 8.0, 5, 0.7
#: A word that is in so many labelled documents, of which less than PURITY are toxic, is no further node. The scan leaves out so many of
#: the most frequent of these words itself, a join the rest: results don't depend on COMMON.
EVIDENCE, COMMON = 20, 1 << 17
#: The mutual information is lessened by SHIFT, so that sharing a language makes no edge.
NEIGHBOURS, SHIFT, RESTART, STEPS = 25, float(np.log(5)), 0.15, 60
#: Words of at least this polarity count, each with how far it lies above the middle, from 0 to 1.
POLARITY, TOXIC = 0.75, 0.5
_HELD = 1 << 19


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(values), np.bool_)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text, sorted by text and hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), np.bool_)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def _copies(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A hash of the words of each of n texts in their order; 0 for a text without words."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    place = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
    out[doc[start]] = tokens.mix(np.add.reduceat(tokens.mix(h + place.astype(np.uint64) * tokens.BASE), start))
    return out


def walk(a: np.ndarray, b: np.ndarray, weight: np.ndarray, start: np.ndarray, restart: float = RESTART, steps: int = STEPS) -> np.ndarray:
    """How much of a walk that restarts at `start` meets each node, along the edges a - b, each of which is given both ways.

    Moves are normalised by both ends' degrees, so that a node whose edges are all weak passes little on.
    """
    degree = np.bincount(a, weights=weight, minlength=len(start))
    share = weight / np.sqrt(degree[a] * degree[b])
    home = start / max(start.sum(), 1)
    p = home.copy()
    for _ in range(steps):
        p = (1 - restart) * np.bincount(b, weights=p[a] * share, minlength=len(start)) + restart * home
    return p


def _labelled(known: decontaminate.Filter):
    """key, copies and the distinct words of the texts whose key may be one of those that are known."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.table()
        for batch in batches:
            key = batch.column("key").to_numpy()
            own = decontaminate._places(table, key.view(np.uint64))
            for at, texts in tokens.steps(batch.column("text").take(pa.array(own)).to_pylist()):
                h, doc = tokens.word_hashes(texts)
                words, of = _distinct(h, doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[own[at : at + len(texts)]]), pa.array(_copies(h, doc, len(texts)).view(np.int64)), _lists(of, words, len(texts))], names=["key", "copies", "words"]
                )

    return run


def _held(toxic: np.ndarray, clean: np.ndarray, common: np.ndarray):
    """copies, the number of toxic seeds and the distinct words that may be nodes of every text. All three sets are sorted."""
    common = np.setdiff1d(common, np.union1d(toxic, clean))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tokens.steps(batch.column("text").to_pylist()):
                h, doc = tokens.word_hashes(texts)
                maybe = ~_among(h, common)
                words, of = _distinct(h[maybe], doc[maybe])
                seeds = np.bincount(of[_among(words, toxic)], minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_copies(h, doc, len(texts)).view(np.int64)), pa.array(seeds.astype(np.int32)), _lists(of, words, len(texts))], names=["copies", "seeds", "words"]
                )

    return run


def _pairs(nodes: np.ndarray):
    """Texts that hold each two nodes, or one if the two are the same, by their places in `nodes`, which is sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)

        for batch in batches:
            column = batch.column("words")
            word, count = column.flatten().to_numpy().view(np.uint64), np.asarray(column.value_lengths())
            doc = np.repeat(np.arange(len(count)), count)
            some = _among(word, nodes)
            place, doc = np.searchsorted(nodes, word[some]), doc[some]
            start, size = np.searchsorted(doc, doc), np.bincount(doc, minlength=len(count))[doc]
            # every node with those of its text up to itself, some nodes at a time
            own = np.arange(len(doc)) - start + 1
            for rows in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(np.cumsum(own) // _HELD)) + 1):
                left = np.repeat(rows, own[rows])
                right = np.arange(len(left)) - np.repeat(np.cumsum(own[rows]) - own[rows], own[rows]) + start[left]
                keys.append(place[right] * len(nodes) + place[left])
                counts.append(np.ones(len(left), np.int64))
                held += len(left)
                if held > 2 * _HELD:
                    key, n = merged()
                    keys, counts, held = [key], [n], len(key)
                    if held > _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                        keys, counts, held = [], [], 0
        if held:
            key, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    return run


def _far(hits: str, n: str, share: float):
    """How many standard deviations the hits of n tries lie over what is expected at this share."""
    hits, n = F.col(hits), F.col(n)
    return (hits - n * F.lit(share)) / F.sqrt(F.greatest(n * F.lit(share * (1 - share)), F.lit(1e-9)))


def _hashes(df: DataFrame) -> np.ndarray:
    return np.sort(df.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def seeds(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Hashes of the toxic and of the clean seed words, and h, n of the words known not to be toxic (None if there are no seeds); docs: key, text.

    All labelled documents are read, however many there are. Clean seeds are as many as the toxic ones, at most as frequent among the labelled documents as the most frequent of
    those, no more toxic than the labelled documents on the whole, and of these the least toxic.
    """
    prepare(docs.sparkSession)
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), None
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.xxhash64("doc_id").alias("key")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = decontaminate.Filter(marked.select(F.col("key").alias("h")))
    # what the filter lets through falsely goes in the join; copies have the same words, whichever is taken
    found = docs.mapInArrow(_labelled(known), "key long, copies long, words array<long>").join(marked, "key")
    one = written(found.groupBy("copies").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words")).select("toxic", "words"), "labelled")
    n, a = one.agg(F.count("*"), F.sum("toxic")).first()
    if not a:
        return none
    counts = one.select("toxic", F.explode("words").alias("h")).groupBy("h").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    counts = written(counts.withColumn("far", _far("a", "n", a / n)), "evidence")
    bad = counts.where((F.col("far") >= DEVIATIONS) & (F.col("a") >= LEAST_DOCS) & (F.col("a") >= PURITY * F.col("n"))).select("h", "n").toArrow()
    if not len(bad):
        return none
    good = counts.where((F.col("far") <= 0) & (F.col("n") <= int(bad["n"].to_numpy().max()))).orderBy("far", "h").limit(len(bad))
    known = counts.where((F.col("n") >= EVIDENCE) & (F.col("a") < PURITY * F.col("n"))).select("h", "n")
    return np.sort(bad["h"].to_numpy().view(np.uint64)), _hashes(good), known


def induce(docs: DataFrame, toxic: np.ndarray, clean: np.ndarray, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the nodes, sorted, and their polarity, from what `seeds` gives. docs: key, text of all documents, each of which is counted, copies once."""
    common = _hashes(known.orderBy(F.desc("n"), "h").limit(COMMON))
    held = docs.select("text").mapInArrow(_held(toxic, clean, common), "copies long, seeds int, words array<long>")
    # copies have the same words, whichever is taken
    one = written(held.groupBy("copies").agg(F.max("seeds").alias("seeds"), F.min("words").alias("words")).select("seeds", "words"), "distinct")
    n_docs, holding = one.agg(F.count("*"), F.sum((F.col("seeds") > 0).cast("long"))).first()
    near = one.select((F.col("seeds") > 0).cast("long").alias("m"), F.explode("words").alias("h")).groupBy("h").agg(F.sum("m").alias("m"), F.count("*").alias("n"))
    near = near.where((F.col("m") >= LEAST_DOCS) & (F.col("m") >= PURITY * F.col("n")) & (_far("m", "n", holding / n_docs) >= DEVIATIONS))
    nodes = np.union1d(np.union1d(toxic, clean), _hashes(near.join(known, "h", "left_anti")))
    pairs = one.select("words").mapInArrow(_pairs(nodes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.select(F.floor(F.col("pair") / len(nodes)).alias("i"), F.pmod("pair", F.lit(len(nodes))).alias("j"), "n")
    pairs = written(pairs, "pairs")
    # edges of one node from the other's point of view and back; only the nearest of each are sent
    count = pairs.where("i = j")
    left, right = count.select("i", F.col("n").alias("df_i")), count.select("j", F.col("n").alias("df_j"))
    pairs = pairs.where("i <> j")
    pairs = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    ppmi = F.log(F.col("n") * F.lit(float(n_docs)) / (F.col("df_i") * F.col("df_j")))
    edges = pairs.join(left, "i").join(right, "j").select("i", "j", (ppmi - SHIFT).alias("w")).where("w > 0")
    best = edges.groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("far"), "j"))), 1, NEIGHBOURS).alias("to"))
    best = best.select("i", F.explode("to").alias("to")).select("i", F.col("to.j").alias("j"), (-F.col("to.far")).alias("w")).toArrow()
    i, j, w = (best[c].to_numpy() for c in ("i", "j", "w"))
    i, j, w = np.r_[i, j], np.r_[j, i], np.r_[w, w]
    plus, minus = (walk(i, j, w, _among(nodes, s).astype(float)) for s in (toxic, clean))
    # what neither walk reaches keeps the middle
    return nodes, np.divide(plus, plus + minus, out=np.full(len(nodes), 0.5), where=plus + minus > 0)


def _score(words: np.ndarray, weight: np.ndarray, toxic: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tokens.steps(batch.column("text").to_pylist()):
                h, doc = tokens.word_hashes(texts)
                some = _among(h, words)
                h, doc = _distinct(h[some], doc[some])
                score = np.bincount(doc, weights=weight[np.searchsorted(words, h)], minlength=len(texts)).astype(float)  # whole numbers if there are no words
                hits = np.bincount(doc, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(np.round(score, 6)), pa.array(hits.astype(np.int32)), pa.array(score >= toxic)], names=["doc_id", "score", "n_words", "toxic"]
                )

    return run


def lexicon(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lexicon's words, sorted, and their weights, from 0 to 1. It is empty without toxic seeds."""
    prepare(docs.sparkSession)
    named = docs.select(F.xxhash64("doc_id").alias("key"), "text")
    toxic, clean, known = seeds(named, labels)
    if known is None:
        return toxic, np.empty(0)
    nodes, polarity = induce(named, toxic, clean, known)
    strong = polarity >= POLARITY
    return nodes[strong], 2 * polarity[strong] - 1


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, n_words, toxic for every row of docs.

    score sums the weights, 0.5 to 1, of the distinct lexicon words of the whole text, n_words counts them, toxic says whether score
    reaches TOXIC. Null and empty texts have score 0; very long ones are read whole. Null ids are scored like others, but have no labels. Copies, which have the same words in the same order,
    repeated rows too, are counted once; texts that differ in a word count each; of several labels of one document or its copies the greatest counts. Without labelled
    documents, or if no word is tied to toxic ones, all scores are 0. Of equally clean seed words the lesser hash is
    taken first. Words and doc_ids are known by hashes of 64 bits. Further columns are not read. An empty table gives no rows.
    """
    words, weight = lexicon(docs, labels)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score(words, weight, TOXIC), f"doc_id {id_type}, score double, n_words int, toxic boolean")
