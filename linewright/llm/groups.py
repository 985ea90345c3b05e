"""Comparing the members of many groups at once, in sorted batches that whole groups share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Groups of up to so many members are compared pair by pair, all of a batch at once.
SMALL = 48


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of their first column, cut so that no value is in two of them; of at least `rows` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        last = batch.column(0)[-1].as_py()
        if size < rows or held[0].column(0)[0].as_py() == last:
            continue
        if batch.column(0)[0].as_py() != last:
            cut = int(np.flatnonzero(batch.column(0).to_numpy() == last)[0])
            whole, rest = [*held[:-1], batch.slice(0, cut)], batch.slice(cut)
        else:  # the last value may reach back into earlier batches
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(joined.column(0).to_numpy() == last)[0])
            whole, rest = [joined.slice(0, cut)], joined.slice(cut)
        yield from pa.Table.from_batches(whole).combine_chunks().to_batches()
        held, size = [rest], rest.num_rows
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component, of n members and links i, j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return root


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both places of every pair within groups of so many places from their starts on."""
    rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    first = np.repeat(starts, sizes)
    earlier = rows - first
    j = np.repeat(rows, earlier)
    i = np.arange(earlier.sum()) - np.repeat(np.cumsum(earlier) - earlier, earlier) + np.repeat(first, earlier)
    return i, j


def group_roots(group: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], like: Callable[[int, int, int], np.ndarray]) -> np.ndarray:
    """The first row that each row reaches within its group, through rows that are alike. Rows of a group are adjacent.

    alike(i, j): of each pair of rows, whether they are alike; like(one, a, n): whether each of the n rows from a on is
    like the one.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    i, j = pairs_within(starts, np.where(sizes <= SMALL, sizes, 1))
    on = alike(i, j)
    root = joined(len(group), i[on], j[on])
    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        open_ = np.ones(n, bool)
        for seed in range(n):
            if not open_[seed]:
                continue
            open_[seed] = False
            reached = [seed]
            while reached:
                new = np.flatnonzero(like(a + reached.pop(), a, n) & open_)
                open_[new] = False
                root[a + new] = a + seed
                reached += new.tolist()
    return root


def ties(batch: pa.RecordBatch, root: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each row's member (the second column) with that of its root, where they differ, each pair once."""
    rep = batch.column(1).to_numpy()
    on = root != np.arange(len(root))
    if on.any():
        a, b = rep[root[on]], rep[on]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], schema=schema)
