"""SentencePiece encoding and decoding as a batched numpy Viterbi search.

A text is cut wherever no piece spans the cut, so that cuts lie at least between words. The distinct words of a step are
grouped by length and all words of one length advance together, one position at a time. At every position the hashes of
the substrings that end there probe the sorted keys of the pieces. A path may only go on with a piece that can stand
behind the path's last one, that is, if merging in order of score would leave the two apart; by this constraint at most
one piece can end a path, so that the maximum over lengths, which is kept as the backpointer, gives the very ids that
merging by score gives. The sum of the pieces' scores alone would not: in a model of the BPE kind they are merge
ranks and no log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks, tokens
from quire.runtime import prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_FAR = np.int64(1) << np.int64(40)
_SPACE, _SIGN = 0x20, 0x2581
#: Characters of a step; tokens of distinct words that a worker remembers, and slots of its memory of pairs.
STEP, REMEMBER, SLOTS = 1 << 20, 8_000_000, 1 << 20


def _values(codes: np.ndarray) -> np.ndarray:
    return tokens.mix(codes.astype(np.uint64) + np.uint64(0x51_7C_C1_B7_27_22_0A_95))


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


@dataclass
class Model:
    """The pieces as arrays. Numbers count single characters first and then merged pieces in the order of merging."""

    keys: np.ndarray  # sorted hashes of the pieces that can be reached
    number: np.ndarray  # the number of each of them
    ids: np.ndarray  # id by number
    left: np.ndarray  # the two parts that are merged last, by number; a single character has itself
    right: np.ndarray
    pairs: np.ndarray  # sorted left << 32 | right, and the number that they merge to
    merged: np.ndarray
    longest: int
    single: np.ndarray  # sorted code points that are pieces
    inner: np.ndarray  # a bit for every two of them: whether they occur side by side inside of a piece
    byte_id: np.ndarray  # id by byte
    raw: np.ndarray  # bytes of all pieces by id, with their starts
    raw_start: np.ndarray
    unknown: int
    _slots: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)
    _known: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = field(default=None, repr=False)
    _filter: np.ndarray | None = field(default=None, repr=False)
    _inner: np.ndarray | None = field(default=None, repr=False)

    # -- which two pieces can stand side by side

    def _derive(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b in order of score ends with a and b. The merges are undone, last one first."""
        ok, limit = np.ones(len(a), np.bool_), np.full(len(a), _FAR)
        a, b, live = a.copy(), b.copy(), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << np.int64(32) | y
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            early = (self.pairs[at] == key) & (self.merged[at] < limit[live]) if len(self.pairs) else np.zeros(len(live), np.bool_)
            ok[live[early]] = False
            live, x, y = live[~early], x[~early], y[~early]
            can_x, can_y = self.right[x] != x, self.left[y] != y
            undo_x = can_x & ((x > y) | ~can_y)
            undo_y = can_y & ~undo_x
            a[live[undo_x]], limit[live[undo_x]] = self.right[x[undo_x]], x[undo_x]
            b[live[undo_y]], limit[live[undo_y]] = self.left[y[undo_y]], y[undo_y] + 1
            live = live[undo_x | undo_y]
        return ok

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_derive with a memory that each pair has one slot in."""
        if self._slots is None:
            self._slots = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.bool_)
        held, verdict = self._slots
        key = a << np.int64(32) | b
        slot = (tokens.mix(key.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        out, miss = verdict[slot], held[slot] != key
        if miss.any():
            some, where = np.unique(key[miss], return_inverse=True)
            new = self._derive(some >> np.int64(32), some & np.int64(0xFFFFFFFF))
            out[miss] = new[where]
            # two pairs of one slot: the last written of both arrays is the same one
            at = (tokens.mix(some.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
            at, first = np.unique(at, return_index=True)
            held[at], verdict[at] = some[first], new[first]
        return out

    # -- the search

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 for none."""
        if self._filter is None:
            self._filter = np.zeros(1 << 20, np.bool_)
            self._filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        out = np.full(key.shape, -1, np.int64)
        some = np.nonzero(self._filter[(key >> np.uint64(44)).astype(np.int64)])
        probe = key[some]
        at = np.searchsorted(self.keys, probe)
        at[at == len(self.keys)] = 0
        out[some] = np.where(self.keys[at] == probe, self.number[at], -1)
        return out

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of words, code points of one length that are all pieces: flat, and how many each has."""
        n, size = words.shape
        value, total = _values(words), np.zeros((n, size + 1), np.uint64)
        for k in range(size):
            total[:, k + 1] = total[:, k] * _B + value[:, k]
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.longest, _B)])
        last, back = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int32)
        for end in range(1, size + 1):
            most = min(end, self.longest)
            start = np.arange(end - 1, end - most - 1, -1)
            key = tokens.mix(total[:, end, None] - total[:, start] * power[1 : most + 1])
            found = self.find(key)
            before = last[:, start]
            row, k = np.nonzero((found >= 0) & ((before >= 0) | (start == 0)))
            a, b = before[row, k], found[row, k]
            inner = start[k] > 0
            good = np.ones(len(row), np.bool_)
            good[inner] = self.apart(a[inner], b[inner])
            length = np.zeros((n, most), np.int32)
            length[row[good], k[good]] = k[good] + 1
            best = length.argmax(1)
            back[:, end] = length[np.arange(n), best]
            last[:, end] = np.where(back[:, end] > 0, found[np.arange(n), best], -1)
        at, count = np.full(n, size), np.zeros(n, np.int64)
        out = np.zeros((n, size), np.int64)
        while (live := np.flatnonzero(at > 0)).size:
            count[live] += 1
            out[live, size - count[live]] = last[live, at[live]]
            at[live] -= back[live, at[live]]
        flat = out[np.arange(size)[None, :] >= size - count[:, None]]
        return self.ids[flat], count

    def _new(self, cs: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words, flat, and how many each has; whole: its characters are pieces."""
        count, parts = np.zeros(len(start), np.int64), []
        groups = []
        for length in np.unique(size[whole]):
            own = np.flatnonzero(whole & (size == length))
            for some in np.array_split(own, max(1, len(own) * int(length) // 200_000)):
                ids, n = self.viterbi(cs[start[some][:, None] + np.arange(length)])
                count[some] = n
                groups.append(some)
                parts.append(ids)
        if len(other := np.flatnonzero(~whole)):
            seen = {int(c): [int(self.byte_id[b]) if self.byte_id[b] >= 0 else self.unknown for b in chr(c).encode()] for c in np.unique(cs[start[other]])}
            lists = [seen[int(c)] for c in cs[start[other]]]
            count[other] = [len(x) for x in lists]
            groups.append(other)
            parts.append(np.array([i for x in lists for i in x], np.int64))
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int64)
        for some, ids in zip(groups, parts):
            flat[_gather(first[some], count[some])] = ids
        return flat, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each text has."""
        long = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        joined = tokens.codes("".join(" " + t for t in texts if t))
        cs, own = joined.copy(), np.where(long > 0, long + 1, 0)
        cs[joined == _SPACE] = _SIGN
        cs[joined == _SIGN] = 0  # the sign itself isn't a blank: it is spelt in bytes
        if not len(cs):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        at = np.minimum(np.searchsorted(self.single, cs), len(self.single) - 1)
        known = self.single[at] == cs
        if self._inner is None:
            self._inner = np.unpackbits(self.inner).astype(np.bool_)
        pair = at[:-1].astype(np.int64) * len(self.single) + at[1:]
        cut = np.ones(len(cs), np.bool_)
        cut[1:] = ~(known[:-1] & known[1:] & self._inner[pair])
        ends = np.cumsum(own)
        cut[(ends - own)[own > 0]] = True
        cs = np.where(joined == _SIGN, np.uint32(_SIGN), cs)
        start = np.flatnonzero(cut)
        size = np.diff(np.r_[start, len(cs)])
        room = STEP * 2
        while room < len(cs) + 1:
            room *= 2
        up, down = tokens.powers(room)
        total = np.zeros(len(cs) + 1, np.uint64)
        np.cumsum(_values(joined) * up[: len(cs)], out=total[1:])
        key = tokens.mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))
        unique, where, word = np.unique(key, return_index=True, return_inverse=True)
        if self._known is None or len(self._known[3]) > REMEMBER:
            self._known = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        keys, first, count, flat = self._known
        at = np.searchsorted(keys, unique)
        new = np.ones(len(unique), np.bool_)
        if len(keys):
            new = keys[np.minimum(at, len(keys) - 1)] != unique
        if new.any():
            s = start[where[new]]
            ids, n = self._new(cs, s, size[where[new]], known[s])
            place = np.searchsorted(keys, unique[new])
            keys = np.insert(keys, place, unique[new])
            first = np.insert(first, place, len(flat) + np.cumsum(n) - n)
            count, flat = np.insert(count, place, n), np.r_[flat, ids.astype(np.int32)]
            self._known = keys, first, count, flat
            at = np.searchsorted(keys, unique)
        at = at[word]
        ids = flat[_gather(first[at], count[at])]
        per = np.r_[0, np.cumsum(count[at])][np.searchsorted(start, ends)]
        return ids, np.diff(np.r_[0, per])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of flat ids: the bytes of the pieces with blanks for their signs, without the blank that every text was given."""
        size = np.diff(self.raw_start)[ids]
        data = self.raw[_gather(self.raw_start[:-1][ids], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.cumsum(count)]
        out, at = [], 0
        for end in ends:
            text = data[at:end].decode("utf-8", "replace")
            out.append(text.removeprefix(" "))
            at = end
        return out


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer's message; those of fixed size are left out."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
            yield key >> 3, value
        elif key & 7 == 2:
            size, at = number(at)
            yield key >> 3, data[at : at + size]
            at += size
        else:
            at += 8 if key & 7 == 1 else 4


def check_kind(path: str) -> None:
    """ValueError unless the file is a model of the BPE kind with bytes to fall back on: other kinds need other maxima."""
    with open(path, "rb") as file:
        spec = next((dict(_fields(v)) for k, v in _fields(file.read()) if k == 2), {})
    if spec.get(3, 1) != 2 or not spec.get(35):
        raise ValueError(f"{path} is no SentencePiece model of the BPE kind with byte fallback")


def load(path: str = MODEL) -> Model:
    """The model of a SentencePiece file of the BPE kind whose pieces have bytes to fall back on; ValueError for other kinds."""
    import sentencepiece

    check_kind(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    text = {i: sp.id_to_piece(i) for i in plain}
    order = sorted(plain, key=lambda i: (len(text[i]) > 1, -sp.get_score(i), i))
    names = [text[i] for i in order]
    number = {t: k for k, t in enumerate(names)}
    left, right, pair = list(range(len(names))), list(range(len(names))), {}

    def apart(x: int, y: int) -> bool:
        limit = int(_FAR)
        while True:
            if pair.get((x, y), limit) < limit:
                return False
            can_x, can_y = right[x] != x, left[y] != y
            if can_x and (x > y or not can_y):
                x, limit = right[x], x
            elif can_y:
                y, limit = left[y], y + 1
            else:
                return True

    reached = [len(t) == 1 for t in names]
    for k, t in enumerate(names):
        for cut in range(1, len(t)):
            x, y = number.get(t[:cut], _FAR), number.get(t[cut:], _FAR)
            if x < k and y < k and reached[x] and reached[y] and apart(x, y):
                left[k], right[k], pair[x, y], reached[k] = x, y, k, True
                break
    single = np.unique(np.array([ord(t) for t in names if len(t) == 1], np.uint32))
    place = {chr(c): k for k, c in enumerate(single)}
    inner = np.zeros(len(single) ** 2, np.bool_)
    for t, r in zip(names, reached):
        for a, b in zip(t, t[1:]):
            if r:
                inner[place[a] * len(single) + place[b]] = True
    keys = np.array([_key(t) for t, r in zip(names, reached) if r], np.uint64)
    numbers = np.flatnonzero(reached)
    byte_id = np.full(256, -1, np.int64)
    raw = [b""] * sp.get_piece_size()
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_id[int(sp.id_to_piece(i)[1:-1], 16)] = i
            raw[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
        elif i in text:
            raw[i] = text[i].replace(chr(_SIGN), " ").encode()
    by_key, by_pair = np.argsort(keys), sorted(pair)
    return Model(
        keys[by_key], numbers[by_key], np.array(order, np.int64), np.array(left, np.int64), np.array(right, np.int64),
        np.array([x << 32 | y for x, y in by_pair], np.int64), np.array([pair[p] for p in by_pair], np.int64),
        max(map(len, names), default=1), single, np.packbits(inner), byte_id,
        np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])], sp.unk_id(),
    )


def _key(text: str) -> int:
    total = np.zeros(1, np.uint64)
    for v in _values(tokens.codes(text)):
        total = total * _B + v
    return int(tokens.mix(total)[0])


def _run(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, column = batch.column(0), batch.column(1)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            for at, texts in tokens.steps(column.to_pylist(), STEP):
                ids, count = model.encode(texts)
                exact = np.fromiter((a == b for a, b in zip(texts, model.decode(ids, count))), np.bool_, len(texts))
                none = missing[at : at + len(texts)]
                offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32), mask=np.r_[none, False])
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(at, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(count.astype(np.int32)), pa.array(exact, mask=none)],
                    names=["doc_id", "ids", "n_tokens", "exact"],
                )

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, exact (decoding the ids gives the text again) for every row of docs.

    The whole text is encoded. A null text has null ids, 0 tokens and a null `exact`; an empty one has no ids. Rows
    are not compared, so repeated rows, null ids and ties need no rule; other columns are not read. Characters that the
    model lacks are spelt in bytes. So is U+2581, which the model's own encoder takes for a blank. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_run(load(path)), f"doc_id {id_type}, ids array<int>, n_tokens int, exact boolean")


def _decode(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            count = np.asarray(column.value_lengths().fill_null(0))
            ids = column.flatten().fill_null(-1).to_numpy().astype(np.int64)
            ids = np.where((ids >= 0) & (ids < len(model.raw_start) - 1), ids, model.unknown)
            ends = np.cumsum(count)
            for rows in np.split(np.arange(len(count)), np.flatnonzero(np.diff(ends // STEP)) + 1):
                if len(rows):
                    part = ids[ends[rows[0]] - count[rows[0]] : ends[rows[-1]]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows[0], len(rows)), pa.array(model.decode(part, count[rows]), pa.string(), mask=missing[rows])], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text for every row of doc_id and ids: the text that `encode` took the ids from, exactly.

    Null ids give a null text, no ids an empty one. Ids that the model lacks and null ones among others add nothing. Bytes that are no
    UTF-8 become U+FFFD. Long lists are decoded whole; repeated rows and null doc_ids are rows like any other; further columns
    are not read. An empty table gives no rows.
    """
    prepare(encoded.sparkSession)
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(load(path)), f"doc_id {id_type}, text string")
