"""Whole groups out of a partition that is sorted by its group key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold only whole groups of the long column `key`; no group is split between two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if k[0] != k[-1] or (held and held[-1].column(key)[-1].as_py() != k[0]):
            cut = int(np.searchsorted(k, k[-1]))
            if done := [*held, batch.slice(0, cut)] if cut else held:
                yield pa.Table.from_batches(done)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of equal keys."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return first, np.diff(np.r_[first, len(key)])
