"""Benchmark decontamination: a prefix-filtered set join of item shingles with item-sized windows of the documents.

A document leaks an item if some window of as many shingle positions as the item has holds a share of at least
`containment` of the item's distinct shingles. If the item has s of them, o = ceil(containment * s) are needed, so
any order of them puts one of the needed ones among the first s - o + 1. The order is that of rarity:

1. A first scan counts the documents by item shingle; only counts leave it, summed up before they are shuffled.
2. Each item's shingles are ranked, the rarest first; the first s - o + 1 are its prefix.
3. A second scan looks for prefix shingles alone. What it passes on of a document that holds some is the places around them.
4. A hit is a candidate if the document has the needed number of shingles at all (length bound) and as many places that may
   be an item's stand less than the item's width away from the hit (positional bound).
5. The windows around candidates are verified exactly.

Both scans know the shingles by filters of FILTER bits, whatever the size of the benchmark: what they let through
falsely goes in the joins, which decide on the whole hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import blocks, tokens
from quire.runtime import prepare, written

NGRAM, CONTAINMENT = 3, 0.6
#: Bits of a filter, as a power of two: 8 MB, of which the driver gets the words of 64 bits that aren't 0.
FILTER = 26
#: Places around a hit are counted within distances of powers of two, of which there are so many.
_REACHES = 32
_HELD = 1 << 19


def _item_shingles(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for at, texts in tokens.steps(batch.column("text").to_pylist()):
                h, doc = tokens.shingles(*tokens.word_hashes(texts), n)
                size = np.bincount(doc, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + at)), pa.array(h.view(np.int64)), pa.array(size[doc])], names=["item_id", "h", "width"])

    return run


class Filter:
    """A set of hashes by their first FILTER bits. The driver holds the words of 64 bits in which some are set."""

    def __init__(self, hashes: DataFrame):
        """hashes: a column h."""
        self.power = FILTER
        place = F.shiftrightunsigned("h", 64 - self.power)
        word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - self.power}) & 63 AS int))")
        table = hashes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.word, self.bits = table["word"].to_numpy().astype(np.int32), table["bits"].to_numpy()

    def table(self) -> np.ndarray:
        out = np.zeros(1 << (self.power - 6), np.int64)
        out[self.word] = self.bits
        return out.view(np.uint8)


def _places(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter lets through."""
    place = h >> np.uint64(64 - (len(table).bit_length() + 2))
    return np.flatnonzero((table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)


def _counts(known: Filter, n: int):
    """Number of texts by shingle, each text once, summed up over many texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, total = known.table(), [], 0

        def out() -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], names=["h", "n"])

        for batch in batches:
            for _, texts in tokens.steps(batch.column("text").to_pylist()):
                h, doc = tokens.shingles(*tokens.word_hashes(texts), n)
                some = _places(table, h)
                h, doc = h[some], doc[some]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.ones(len(h), np.bool_)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                held.append(h[first])
                total += int(first.sum())
                if total > _HELD:
                    yield out()
                    held, total = [], 0
        if total:
            yield out()

    return run


def _hits(rare: Filter, known: Filter, n: int, widest: int):
    """A row for each text with a shingle that may be of a prefix.

    text is a key of the row's words, so that texts of one doc_id stay apart; pos and h are the places and shingles that may
    be an item's and stand less than `widest` places from one that may be of a prefix. hit has the indices of the latter,
    and around, _REACHES for each of them, how many places of pos stand less than 1, 2, 4, ... places from it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarely, some_of = rare.table(), known.table()
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in tokens.steps(batch.column("text").to_pylist()):
                h, doc = tokens.shingles(*tokens.word_hashes(texts), n)
                hits = _places(rarely, h)
                if not len(hits):
                    continue
                size = np.bincount(doc, minlength=len(texts))
                start = np.cumsum(size) - size
                total = np.r_[np.uint64(0), np.cumsum(tokens.mix(h + (np.arange(len(h)) - start[doc]).astype(np.uint64) * tokens.BASE))]
                key = total[start + size] - total[start]
                places = np.union1d(_places(some_of, h), hits)
                # texts are so far apart on this axis that no distance reaches from one to another
                gap = np.int64(len(h) + widest)
                axis = places + doc[places] * gap
                mark = hits + doc[hits] * gap
                after = np.searchsorted(mark, axis)
                near = np.minimum(np.abs(axis - mark[np.minimum(after, len(mark) - 1)]), np.abs(axis - mark[np.maximum(after - 1, 0)])) < widest
                places, axis = places[near], axis[near]
                reach = np.minimum(np.int64(1) << np.arange(_REACHES, dtype=np.int64), gap)
                around = np.searchsorted(axis, mark[:, None] + reach, side="left") - np.searchsorted(axis, mark[:, None] - reach, side="right")
                own = np.unique(doc[hits])
                ends, first = np.searchsorted(doc[places], own, side="right"), np.searchsorted(doc[places], own)
                hit_ends = np.searchsorted(doc[hits], own, side="right")
                lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))
                index = np.searchsorted(places, hits) - first[np.searchsorted(own, doc[hits])]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(own + at)), pa.array(key[own].view(np.int64)), pa.array(size[own]), lists(ends, places - start[doc[places]]), lists(ends, h[places].view(np.int64)),
                        lists(hit_ends, index.astype(np.int32)), lists(hit_ends * _REACHES, around.astype(np.int32).ravel()),
                    ],
                    names=["doc_id", "text", "size", "pos", "h", "hit", "around"],
                )

    return run


def most_held(group: np.ndarray, pos: np.ndarray, h: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each group, and the most distinct h that any `width` positions of the group hold; sorted by group and pos."""
    first, size = blocks.runs(group)
    number = np.repeat(np.arange(len(first)), size)
    axis = pos + number * (pos.max(initial=0) + width.max(initial=0) + 1)
    order = np.lexsort((axis, h, number))
    same = (h[order][1:] == h[order][:-1]) & (number[order][1:] == number[order][:-1])
    before = np.full(len(pos), -1)
    before[order[1:][same]] = order[:-1][same]
    # a place counts for the windows that begin after the last place of its shingle, up to its own
    low = np.maximum(before + 1, np.searchsorted(axis, axis - width + 1))
    change = np.zeros(len(pos) + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, np.arange(1, len(pos) + 1), -1)
    held = np.cumsum(change)[:-1]
    return first, np.maximum.reduceat(held, first) if len(first) else held


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in blocks.whole_groups(batches, "pair"):
        pair, pos, h, width, need, s = (table[c].to_numpy() for c in ("pair", "pos", "h", "width", "need", "s"))
        first, most = most_held(pair, pos, h, width)
        ok = most >= need[first]
        first = first[ok]
        rows = pa.array(first)
        yield pa.RecordBatch.from_arrays(
            [table["doc_id"].take(rows).combine_chunks(), table["item_id"].take(rows).combine_chunks(), pa.array(np.round(most[ok] / s[first], 6))], names=["doc_id", "item_id", "containment"]
        )


def ranked_items(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, containment: float = CONTAINMENT) -> tuple[DataFrame, Filter]:
    """item_id, width, s, h, rank, need of each item's shingles, written, rarest first; and the filter of them all.

    An item_id with several texts of different length is an item for each length.
    """
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    items = items.mapInArrow(_item_shingles(n), f"item_id {item_type}, h long, width long").distinct()
    items = written(items, "items")
    known = Filter(items.select("h"))
    counts = docs.select("text").mapInArrow(_counts(known, n), "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))
    own = Window.partitionBy("item_id", "width")
    ranked = items.join(counts, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy("df", "h"))).withColumn("s", F.count("*").over(own))
    return written(ranked.withColumn("need", F.ceil(F.col("s") * F.lit(containment) - 1e-9)), "ranked"), known


def candidates(named: DataFrame, ranked: DataFrame, known: Filter, n: int) -> tuple[DataFrame, DataFrame]:
    """The texts with hits, written, as `_hits` gives them; and doc_id, text, item_id, width of the pairs that both bounds leave, written."""
    prefix = ranked.where(F.col("s") - F.col("rank") + 1 >= F.col("need")).select("h", "item_id", "width", "need")
    widest = int(ranked.agg(F.max("width")).first()[0] or 1)
    id_type = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text long, size long, pos array<long>, h array<long>, hit array<int>, around array<int>"
    found = written(named.mapInArrow(_hits(Filter(prefix.select("h")), known, n, widest), schema), "hits")
    hit = found.select("doc_id", "text", "size", "h", "around", F.posexplode("hit").alias("k", "i"))
    hit = hit.select("doc_id", "text", "size", F.get("h", "i").alias("h"), F.slice("around", F.col("k") * _REACHES + 1, _REACHES).alias("around"))
    hit = hit.join(prefix, "h").where(F.col("size") >= F.col("need"))
    power = F.least(F.ceil(F.log2("width")).cast("int"), F.lit(_REACHES - 1))
    hit = hit.where(F.get("around", power) >= F.col("need"))
    return found, written(hit.select("doc_id", "text", "item_id", "width").distinct(), "candidates")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, containment: the greatest share of the item's distinct n-word shingles in one window, if it is large enough.

    Words are runs of letters and numbers in lower case. Items of fewer than n words, and null texts, ids and items, take
    no part. Repeated rows give one result; of several texts or items of one id the greatest share counts. Shingles of
    equal rarity are ranked by hash, which changes no result. Very long texts are searched whole. Shingles, texts and
    pairs are known by hashes of 64 bits. Other columns aren't read. An empty table of either kind gives no rows.
    """
    prepare(docs.sparkSession)
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    ranked, known = ranked_items(named, benchmark, n, containment)
    found, pairs = candidates(named, ranked, known, n)
    key = ["doc_id", "text"]
    places = found.join(pairs.select(*key).distinct(), key, "left_semi").select(*key, F.explode(F.arrays_zip("pos", "h")).alias("at")).select(*key, "at.pos", "at.h")
    places = places.join(ranked.select("h", "item_id", "width", "s", "need"), "h").join(pairs, [*key, "item_id", "width"], "left_semi")
    places = places.distinct().withColumn("pair", F.xxhash64(*key, "item_id", "width"))
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, containment double"
    held = places.repartition("pair").sortWithinPartitions("pair", "pos").mapInArrow(_verify, types)
    return held.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))
