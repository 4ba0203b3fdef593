"""N-gram Jaccard join by chosen paths: the links between documents whose word-shingle sets are alike.

Every set is cut to a signature of min-hashes, so that two sets agree on one coordinate with a probability of their
Jaccard similarity. A run starts with all sets in one node. Each node picks BRANCH coordinates of the signature from
its own path, that is BRANCH shared tokens, and sends every set to the children these tokens name. Nodes of up to
`bucket` sets are compared by brute force, larger ones are split again. Pairs whose sketches are far apart are let go,
all others are verified on the whole sets. Runs are repeated, all at once, as often as the target recall needs.

Documents with one set are one node of the join from the start, so copies are never paired with each other. The result
has a row for each document: its class, which is the connected component of its links, and how many links it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks, tokens
from quire.runtime import prepare, written

NGRAM, THRESHOLD, RECALL, BUCKET, LEVELS = 3, 0.45, 0.95, 50, 3
#: Coordinates of a signature; children of a node; sets in one tile of a bucket that can't be split further.
COORDS, BRANCH, TILE = 64, 2, 512
#: How far below the threshold a sketch may lie: over three standard deviations of an estimate from COORDS bytes. A pair
#: at the threshold lies below that with a probability of 0.0006, so its recall is that of the paths times 0.9994.
SLACK = 0.2

_MULTIPLIERS = tokens.mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)


def runs_needed(threshold: float, recall: float, levels: int) -> int:
    """Runs that find a pair at the threshold with probability `recall` even if each run splits it `levels` times."""
    once = (1 - (1 - threshold) ** BRANCH) ** levels
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once))) if recall > 0 and once < 1 else 1


def _sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingles of the texts that have words; the texts' numbers, first shingles and node keys."""
    h, d = tokens.sets(texts, n)
    first, size = blocks.runs(d)
    if not len(first):
        return h, d, first, np.empty(0, np.int64)
    node = tokens.mix(np.add.reduceat(tokens.mix(h ^ np.uint64(0xA5A5A5A5)), first) + size.astype(np.uint64))
    return h, d[first], first, node.view(np.int64)


def _sign(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in tokens.steps(batch.column(1).to_pylist()):
                h, doc, first, node = _sets(texts, n)
                if not len(doc):
                    continue
                sig = np.empty((len(doc), COORDS), np.uint32)
                for k, a in enumerate(_MULTIPLIERS):
                    sig[:, k] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), first)
                offsets = np.arange(len(doc) + 1, dtype=np.int32)
                sketch = np.ascontiguousarray(sig.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc + at)),
                        pa.array(node),
                        pa.ListArray.from_arrays(offsets * COORDS, pa.array(sig.view(np.int32).ravel())),
                        pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets * COORDS), pa.py_buffer(sketch)]),
                    ],
                    names=["doc_id", "node", "sig", "sketch"],
                )

    return run


def _children(front: DataFrame) -> DataFrame:
    """(path, node) for BRANCH coordinates that the parent's path picks; front has path, node and sig."""
    one = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDS))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(COORDS - 1)), F.lit(COORDS))
    pick = lambda c: F.xxhash64("path", c, F.element_at("sig", (c + 1).cast("int")))
    return front.select("node", F.explode(F.array(pick(one), pick(two))).alias("path"))


def _close(keep: float):
    """Pairs of sets of one bucket whose sketches agree on a share of at least `keep` of the coordinates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_groups(batches, "path"):
            path, node, tile = (table[c].to_numpy() for c in ("path", "node", "tile"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, COORDS)
            first, size = blocks.runs(path)
            for m in np.unique(size[size > 1]):
                left, right = np.triu_indices(int(m), 1)
                starts = first[size == m]
                for some in np.array_split(starts, max(1, len(starts) * len(left) // 200_000)):
                    a, b = (some[:, None] + left).ravel(), (some[:, None] + right).ravel()
                    # a bucket that was cut in tiles compares two different tiles here, or one with itself
                    same = np.ones(len(a), np.bool_)
                    split = np.repeat(tile[some] >= 0, len(left))
                    if split.any():
                        crossing = np.repeat([len(np.unique(tile[s : s + m])) > 1 for s in some], len(left))
                        same = ~split | ~crossing | (tile[a] != tile[b])
                    a, b = a[same], b[same]
                    near = np.empty(len(a), np.bool_)
                    for i in range(0, len(a), 50_000):
                        near[i : i + 50_000] = (sketch[a[i : i + 50_000]] == sketch[b[i : i + 50_000]]).mean(1) >= keep
                    a, b = a[near], b[near]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b])), pa.array(path[a])], names=["a", "b", "path"]
                    )

    return run


def _fetch(n: int):
    """(block, a, b, set): the set of each wanted document for every block it is wanted in; b is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, where = batch.column("node").to_numpy(), batch.column("blocks").to_pylist()
            for at, texts in tokens.steps(batch.column("text").to_pylist()):
                h, doc, first, node = _sets(texts, n)
                ends = np.r_[first[1:], len(h)]
                out = [(k, int(v), h[s:e].tobytes()) for v, i, s, e in zip(node, doc, first, ends) if v == want[at + i] for k in where[at + i]]
                for i in range(0, len(out), 2000):
                    k, v, s = zip(*out[i : i + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(s, pa.binary())], names=["block", "a", "b", "set"])

    return run


def _overlaps(of: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]."""
    if len(a) < 100:
        return np.array([len(np.intersect1d(of[x], of[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    index = {x: i for i, x in enumerate(np.unique(np.r_[a, b]))}
    flat = np.concatenate([of[x] for x in index])
    row = np.repeat(np.arange(len(index)), [len(of[x]) for x in index])
    words, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # the rest can't be in any intersection
    column, row, width = (np.cumsum(shared) - 1)[column][shared[column]], row[shared[column]], int(shared.sum())
    out = np.zeros(len(a), np.int64)
    x, y = (np.array([index[v] for v in s]) for s in (a, b))
    for at in range(0, width, 1 << 16):
        some = (column >= at) & (column < at + (1 << 16))
        bits = np.zeros((len(index), min(1 << 16, width - at) + 63 & ~63), np.bool_)
        bits[row[some], column[some] - at] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(0, len(a), 1000):
            out[i : i + 1000] += np.bitwise_count(bits[x[i : i + 1000]] & bits[y[i : i + 1000]]).sum(1, dtype=np.int64)
    return out


def _verify(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_groups(batches, "block"):
            block, a = table["block"].to_numpy(), table["a"].to_numpy()
            pair = table["b"].is_valid().to_numpy(zero_copy_only=False)
            b, of = table["b"].fill_null(0).to_numpy(), table["set"]
            outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, m in zip(*blocks.runs(block)):
                k = np.arange(s, s + m)
                have = {int(a[i]): np.frombuffer(of[int(i)].as_py(), np.uint64) for i in k[~pair[k]]}
                x, y = a[k[pair[k]]], b[k[pair[k]]]
                if not len(x):
                    continue
                both = _overlaps(have, x, y)
                sizes = np.array([len(have[int(u)]) + len(have[int(v)]) for u, v in zip(x, y)])
                jaccard = both / (sizes - both)
                ok = jaccard >= threshold
                outs.append((x[ok], y[ok], jaccard[ok]))
            if outs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*outs)], names=["a", "b", "jaccard"])

    return run


def signatures(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """doc_id, node (a key of the shingle set), sig, sketch of each document with an id and at least one word; written."""
    prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    return written(signed.mapInArrow(_sign(n), f"doc_id {id_type}, node long, sig array<int>, sketch binary"), "signatures")


def similar_sets(docs: DataFrame, signed: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """a < b, jaccard: pairs of different shingle sets, by node, that are alike."""
    nodes = signed.groupBy("node").agg(F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
    nodes = written(nodes, "nodes")
    roots = F.array(*[F.lit(7919 * (r + 1)).cast("long") for r in range(runs_needed(threshold, recall, levels))])
    front, leaves = nodes.select("node", "sig", F.explode(roots).alias("path")), None
    for level in range(levels):
        rows = _children(front)
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        rows = written(rows.join(sizes, "path"), "level")
        last = level + 1 == levels
        leaf = rows if last else rows.where(F.col("n") <= bucket)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        if last or (big := rows.where(F.col("n") > bucket)).isEmpty():
            break
        front = big.join(nodes.select("node", "sig"), "node")
    # a bucket over TILE is compared tile by tile, each two of its tiles in a place of their own
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node", F.lit(3)), tiles.cast("long")).cast("int")
    small = leaves.where(F.col("n") <= TILE).select("node", "path", F.lit(-1).alias("tile"))
    large = leaves.where(F.col("n") > TILE).select("node", "path", tile.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    large = large.select("node", F.xxhash64("path", F.least("tile", "other"), F.greatest("tile", "other")).alias("path"), "tile")
    placed = small.unionByName(large).join(nodes.select("node", "sketch"), "node")
    close = placed.repartition("path").sortWithinPartitions("path").mapInArrow(_close(threshold - SLACK), "a long, b long, path long")
    pairs = written(close.groupBy("a", "b").agg(F.min("path").alias("block")), "pairs")
    want = pairs.select("block", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.collect_set("block").alias("blocks"))
    want = want.join(nodes.select("node", "doc_id"), "node").hint("shuffle_hash")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(want, "doc_id").select("node", "blocks", "text")
    fetched = texts.mapInArrow(_fetch(n), "block long, a long, b long, set binary")
    asked = pairs.select("block", "a", "b", F.lit(None).cast("binary").alias("set"))
    both = fetched.unionByName(asked).repartition("block").sortWithinPartitions("block")
    return both.mapInArrow(_verify(threshold), "a long, b long, jaccard double")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges a, b: the label is the least node of its connected component.

    Large and small stars take turns: every node hands its greater neighbours, then its lesser ones and itself, to the
    least of them. The edges never become more, and the turns grow as the square of the logarithm of their number at
    most, whatever the diameter. A node's neighbours are never brought together: its least one is a combined minimum
    and goes back by a join, whose hot keys the adaptive plan splits.
    """
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(least(large), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), "edges")
        if (after := state(edges)) == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _classes(signed: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, doc_id) of every set of a document, and doc_id, class_id for the documents in a class of at least two.

    A doc_id with several texts holds their sets together. pairs: a, b of alike sets, written.
    """
    members = signed.select("node", "doc_id").distinct()
    first = members.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").drop("last")
    own = members.join(first, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")
    label = components(pairs.select("a", "b").unionByName(own))
    group = members.join(label, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    heads = group.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last")).where("class_id <> last").drop("last")
    return members, group.join(heads, "label").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document with an id.

    Two texts are linked if their sets of n-word shingles differ and have a Jaccard of at least `threshold`, verified on the
    whole sets. A link at the threshold is found with probability `recall` (times 0.9994, see SLACK), likelier ones more
    surely. Texts of equal sets are copies, which are always found. class_id is the least doc_id of the connected
    component of all links and copies, for a document without any its own. n_links counts the other sets that the
    document's is linked to, n_copies the other documents of an equal set.

    A text of fewer than n words is one shingle of all its words. Documents without a word (null or empty text) are by
    themselves, with 0 links and copies; rows without doc_id are left out. Repeated rows count once; the several texts of
    one doc_id belong to one class, and the greatest of their counts holds. Very long texts are compared whole. doc_id
    keeps its type. Further columns are not read. An empty table gives no rows.
    """
    signed = signatures(docs, n)
    pairs = written(similar_sets(docs, signed, n, threshold, recall, bucket, levels), "alike")
    members, classes = _classes(signed, pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    counts = members.groupBy("node").agg(F.count("*").alias("n")).join(links, "node", "left")
    counts = members.join(counts, "node").groupBy("doc_id").agg(F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"), F.max(F.col("n") - 1).alias("n_copies"))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    every = ids.join(counts, "doc_id", "left").join(classes, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", zero).alias("n_copies"))


def group_heads(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, head of every document in a group of alike documents: head is the group's least doc_id.

    Groups are the classes of `jaccard_join`, which has its parameters and rules; besides, all documents whose text isn't
    null but has no word are one group, as their sets are equal. Rows without doc_id are in no group. An empty table gives no rows.
    """
    signed = signatures(docs, parameters.get("n", NGRAM))
    pairs = written(similar_sets(docs, signed, **parameters), "alike")
    heads = _classes(signed, pairs)[1].withColumnRenamed("class_id", "head")
    bare = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct().join(signed.select("doc_id"), "doc_id", "left_anti")
    least = bare.agg(F.min("doc_id")).first()[0]
    return heads.unionByName(bare.select("doc_id", F.lit(least).cast(docs.schema["doc_id"].dataType).alias("head")))
