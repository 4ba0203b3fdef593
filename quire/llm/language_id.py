"""Language identification by rank-order n-gram profiles.

The n-grams of 1 to 3 letters of every word, which is padded with a blank on each side, are counted over the whole
text; the PROFILE most frequent, in order, are the document's profile. A language's profile is made the same way from
labelled documents. The out-of-place distance is the sum over the document's n-grams of how far their ranks differ,
PROFILE for one that the language lacks. It is divided by the most it could be, so it lies between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import blocks, tokens
from quire.runtime import prepare

#: N-grams in a profile; the number of labelled documents of each language that the SQL of op6_language_id learns from.
PROFILE, PER_LANGUAGE = 300, 400
#: A document is accepted if its best distance is no more than this, or than a lesser bound that is learned, and at least MIN_LETTERS of its visible characters are letters.
MAX_DISTANCE, MIN_LETTERS = 0.8, 0.5
#: The bound that is learned: this quantile of the distances of all labelled documents of a language to it, when it is learned from the
#: other half of them, of the language where it is greatest, and so much above it for short and unusual texts. It is never over MAX_DISTANCE.
OWN_QUANTILE, OWN_SLACK = 0.99, 0.1
_BITS, _PAD = 21, 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.bool_)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = True
    return table


@lru_cache(maxsize=1)
def _visible() -> np.ndarray:
    return np.fromiter((not chr(c).isspace() for c in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text and n-gram: text number, n-gram (21 bits a character), count; and the share of letters of each text."""
    low = [t.lower() for t in texts]
    cs = tokens.codes("\n" + "\n".join(low) + "\n")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    letter = _letters()[cs]
    of = np.cumsum(np.r_[letter, False], dtype=np.int64)
    seen = np.cumsum(np.r_[_visible()[cs], False], dtype=np.int64)
    edge = np.r_[0, ends]
    n_letters, n_seen = np.diff(of[edge]), np.diff(seen[edge])
    share = n_letters / np.maximum(n_seen, 1)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a word
    keep[0] = True
    at = np.flatnonzero(keep)
    letter = letter[at]
    used = np.where(letter, cs[at], _PAD)
    doc = np.searchsorted(ends, at - 1, side="right")
    # blank and letters in ascending order as 1..A; 0 is no character
    alphabet = np.unique(used)
    a = np.int64(len(alphabet) + 1)
    x = np.searchsorted(alphabet, used).astype(np.int64) + 1
    one, two, three = x[1:], x[:-1] * a + x[1:], (x[:-2] * a + x[1:-1]) * a + x[2:]
    in_one, in_two, in_three = letter[1:], letter[:-1] | letter[1:], letter[1:-1]
    doc_two = np.where(letter[:-1], doc[:-1], doc[1:])
    room = a * a * a
    key = np.concatenate([doc[1:][in_one] * room + one[in_one], doc_two[in_two] * room + two[in_two], doc[1:-1][in_three] * room + three[in_three]])
    key.sort()
    first, count = blocks.runs(key)
    key = key[first]
    doc, gram = key // room, key % room
    wide = np.r_[0, alphabet].astype(np.int64)
    gram = (wide[gram // (a * a)] << 2 * _BITS) | (wide[gram // a % a] << _BITS) | wide[gram % a]
    return doc, gram, count, share


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, half = np.array(batch.column("lang").to_pylist(), object), batch.column("half").to_numpy()
        for at, texts in tokens.steps(batch.column("text").to_pylist()):
            doc, gram, count, _ = ngrams(texts)
            of, part = langs[at : at + len(texts)], half[at : at + len(texts)]
            for lang, k in sorted(set(zip(of, part))):
                own = ((of == lang) & (part == k))[doc]
                g, where = np.unique(gram[own], return_inverse=True)
                n = np.bincount(where, weights=count[own], minlength=len(g)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), k)), pa.array(g), pa.array(n)], names=["lang", "half", "gram", "n"])


def _labelled(docs: DataFrame) -> DataFrame:
    """lang, text and half, 0 or 1, of all labelled rows. Equal texts are in one half, so that none is held out from its own copies."""
    return docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"))


def _picked(docs: DataFrame, per_language: int) -> DataFrame:
    """The labelled rows of up to `per_language` documents of each language, those with the least hash of doc_id."""
    named = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    picked = named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    return docs.where(F.col("doc_id").isin([r.doc_id for r in picked.select("doc_id").distinct().collect()]))


def _profiles(labelled: DataFrame, size: int) -> list[dict[str, list[int]]]:
    """The profiles from half 0, from half 1 and from all of the rows."""
    prepare(labelled.sparkSession)
    counts = labelled.mapInArrow(_counts, "lang string, half long, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))
    counts = counts.select("lang", "gram", "n", F.explode(F.array("half", F.lit(2).cast("long"))).alias("part")).groupBy("part", "lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("part", "lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size).select("part", "lang", "k", "gram").collect()
    out: list[dict[str, list[int]]] = [{}, {}, {}]
    for r in sorted(top):
        out[r.part].setdefault(r.lang, []).append(r.gram)
    return out


def train(docs: DataFrame, per_language: int | None = None, size: int = PROFILE) -> dict[str, list[int]]:
    """The n-grams of each language of the column lang, most frequent first, from all labelled rows.

    With `per_language` they are from up to so many documents of each, those with the least hash of doc_id. Ties of count
    go to the lesser n-gram. What the driver gets is bounded by the number of languages.
    """
    return _profiles(_labelled(docs if per_language is None else _picked(docs, per_language)), size)[2]


def _own(halves: list[dict[str, list[int]]], size: int):
    """Language and distance to it, rounded as `identify` does, of each labelled text, by the profiles of the half that it isn't in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Profiles(p, size) for p in halves]
        for batch in batches:
            langs, half = batch.column("lang").to_pylist(), batch.column("half").to_numpy()
            for k, model in enumerate(models):
                place = {lang: i for i, lang in enumerate(model.langs)}
                rows = np.array([i for i in np.flatnonzero(half == 1 - k) if langs[i] in place], np.int64)
                own = np.array([place[langs[i]] for i in rows], np.int64)
                for at, texts in tokens.steps(batch.column("text").take(pa.array(rows)).to_pylist()):
                    of = own[at : at + len(texts)]
                    far = model.distances(texts)[0][np.arange(len(texts)), of]
                    some = ~np.isnan(far)
                    yield pa.RecordBatch.from_arrays([pa.array([model.langs[i] for i in of[some]], pa.string()), pa.array(np.round(far[some], 6))], names=["lang", "distance"])

    return run


def learn(docs: DataFrame, size: int = PROFILE, max_distance: float = MAX_DISTANCE) -> tuple[dict[str, list[int]], float]:
    """The profiles that `train` makes of all labelled rows, and the distance up to which a text is taken for one of the languages.

    Each labelled row is measured once, by the profiles of the half that it isn't in. The driver gets one quantile of each
    language. Without a language that both halves have the bound is max_distance.
    """
    labelled = _labelled(docs)
    *halves, whole = _profiles(labelled, size)
    if not set(halves[0]) & set(halves[1]):
        return whole, max_distance
    held = labelled.mapInArrow(_own(halves, size), "lang string, distance double").groupBy("lang", "distance").count()
    far = [r.far for r in held.groupBy("lang").agg(F.percentile("distance", OWN_QUANTILE, F.col("count")).alias("far")).collect()]
    return whole, min(max_distance, max(far) + OWN_SLACK) if far else max_distance


def learn_bound(docs: DataFrame, size: int = PROFILE, max_distance: float = MAX_DISTANCE) -> float:
    """The distance up to which a text is taken for one of the languages, from all labelled rows, as `learn` says."""
    return learn(docs, size, max_distance)[1]


class Profiles:
    """Ranks of all profiles' n-grams as one matrix."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts by languages: the distance, NaN for a text without letters; and the share of letters."""
        doc, gram, count, share = ngrams(texts)
        out = np.full((len(texts), len(self.langs)), np.nan)
        if not len(doc) or not self.langs:
            return out, share
        order = np.lexsort((gram, -count, doc))
        doc, gram = doc[order], gram[order]
        first, length = blocks.runs(doc)
        rank = np.arange(len(doc)) - np.repeat(first, length)
        top = rank < self.size
        doc, gram, rank = doc[top], gram[top], rank[top]
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - rank[:, None]))
        first, length = blocks.runs(doc)
        out[doc[first]] = np.add.reduceat(apart, first, axis=0) / (length * self.size)[:, None]
        return out, share


def _identify(profiles: dict[str, list[int]], size: int, max_distance: float, min_letters: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            best, runner, lang, ok = [], [], [], []
            for _, texts in tokens.steps(batch.column("text").to_pylist()):
                apart, share = model.distances(texts)
                apart = np.c_[apart, np.full(len(apart), np.inf)]
                known = ~np.isnan(apart[:, 0]) if model.langs else np.zeros(len(apart), np.bool_)
                apart[~known] = np.inf
                pick = np.where(known, np.argmin(apart, axis=1), len(model.langs))
                near = np.sort(apart, axis=1)
                best.append(near[:, 0])
                runner.append(near[:, 1] if len(model.langs) > 1 else np.full(len(near), np.inf))
                lang.append(names[pick])
                ok.append(known & (near[:, 0] <= max_distance) & (share >= min_letters))
            best, runner = np.concatenate(best), np.concatenate(runner)
            plain = lambda x: pa.array(np.round(x, 6), mask=~np.isfinite(x))
            gap = np.subtract(runner, best, out=np.full(len(best), np.inf), where=np.isfinite(runner))
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["text"]).columns, pa.array(np.concatenate(lang), pa.string()), plain(best), plain(gap), pa.array(np.concatenate(ok))],
                schema=pa.schema([*batch.drop_columns(["text"]).schema, ("language", pa.string()), ("distance", pa.float64()), ("margin", pa.float64()), ("accepted", pa.bool_())]),
            )

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, max_distance: float = MAX_DISTANCE, min_letters: float = MIN_LETTERS) -> DataFrame:
    """doc_id, language, distance, margin to the next language, accepted: a row for every row of docs.

    A text without letters (null and empty ones too) is "und", with no distance, and not accepted, as is every text if
    no language was learned. Of equally near languages the first by name is taken. Repeated rows and null doc_ids are
    rows like any other, and very long texts are read whole. Other columns are not read, so their names can't clash. An
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _identify(profiles, size, max_distance, min_letters), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, language string, distance double, margin double, accepted boolean"
    )


def accepted_documents(docs: DataFrame, profiles: dict[str, list[int]], **parameters) -> DataFrame:
    """The rows of docs whose text is accepted, all columns as they were.

    Every row is judged by its own text, so repeated rows and null ids need no join. Null, empty and letterless texts are rejected, very long
    ones judged whole, ties as in `identify`. Columns may have any name. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    judge = _identify(profiles, parameters.get("size", PROFILE), parameters.get("max_distance", MAX_DISTANCE), parameters.get("min_letters", MIN_LETTERS))
    text = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (verdict,) = judge([pa.RecordBatch.from_arrays([batch.column(text)], names=["text"])]) if batch.num_rows else (None,)
            if verdict is not None:
                yield batch.filter(verdict.column("accepted"))

    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
