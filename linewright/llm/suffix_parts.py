"""Positions of texts dealt to the parts of a suffix tree, and what a part makes of them.

A tree's branches begin with the word right before, so all states that a position may use lie in the branch of that
word: a part that holds all positions of a branch counts, tests and smooths its states alone. Contexts that are too common
for one part (hot) are dealt by the word before them; their counts are then taken beforehand and sent along as rows of
their own. A position is a column of: cell of the part, row, level (0; of hot counts the length of their context), weight
(1 in training, else 0; of hot counts the count), word, the word's count if it has no broadcast one, and the words before
it, nearest first (0: none, or a word that occurs once).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Word ids are below 2 ** ID_BITS, groups of one cell below 2 ** (63 - ID_BITS).
ID_BITS = 40
CELL, ROW, LEVEL, WEIGHT, WORD, COUNT, BEFORE = range(7)


def narrow(x: np.ndarray) -> np.ndarray:
    """Values in four bytes each if they fit."""
    return x.astype(np.int32) if len(x) and x.max() < 1 << 31 else x


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of int32 or int64, none of them negative, byte by byte of their values, compressed."""
    widths = [(int(x.max()).bit_length() + 7) // 8 if len(x) else 0 for x in columns]
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, j] for x, width in zip(columns, widths, strict=True) for j in range(width)]
    return bytes(widths) + pa.compress(np.concatenate([*planes, np.zeros(1, np.uint8)]), "zstd", asbytes=True)


def unpack(packed: list[bytes], columns: int, sizes: list[int]) -> list[np.ndarray]:
    """The columns that pack was given each time, one after another, in four bytes a value where all fit."""
    widths = [list(x[:columns]) for x in packed]
    out = [np.zeros((sum(sizes), 4 if all(x[k] < 4 for x in widths) else 8), np.uint8) for k in range(columns)]
    start = 0
    for x, width, n in zip(packed, widths, sizes, strict=True):
        planes = np.frombuffer(pa.decompress(memoryview(x)[columns:], sum(width) * n + 1, "zstd"), np.uint8)
        at = 0
        for k in range(columns):
            for j in range(width[k]):
                out[k][start : start + n, j] = planes[at : at + n]
                at += n
        start += n
    return [x.view(np.int32 if x.shape[1] == 4 else np.int64)[:, 0] for x in out]


def mixed(x: np.ndarray) -> np.ndarray:
    """A number below 2 ** 31 for each, well spread."""
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each code and a place of each group, groups in order of their codes."""
    order = np.argsort(codes)
    ranked = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def befores(ids: np.ndarray, ends: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each word the words before it in its text, nearest first, as far as they occur twice."""
    context = ids.copy()
    context[ends] = 0
    out = []
    for d in range(1, depth + 1):
        x = np.zeros_like(ids)
        x[d:] = context[:-d]
        out.append(np.where(out[-1] > 0, x, 0) if out else x)
    return out


class Hot:
    """Contexts dealt over several cells. For each level: codes (place of the shorter context one level up, word before it), and of each the cells its positions go to (first, how many)."""

    def __init__(self, codes: list[np.ndarray], words: list[np.ndarray], first: list[np.ndarray], many: list[np.ndarray]):
        self.codes, self.words, self.first, self.many = codes, words, first, many
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in codes])]).astype(np.int64)

    def states(self, before: list[np.ndarray]) -> Iterator[np.ndarray]:
        """For each level the place of a position's context in it, or -1."""
        place = np.zeros(len(before[0]), np.int64) if before else np.zeros(0, np.int64)
        for codes, word in zip(self.codes, before, strict=False):
            if not len(codes):
                return
            code = (place << ID_BITS) | word
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            place = np.where((place >= 0) & (word > 0) & (codes[at] == code), at, -1)
            yield place

    def cells(self, before: list[np.ndarray], cells: int) -> np.ndarray:
        """The cell of each position: by its longest hot context and one more word, or, if there is none, by turns."""
        out = mixed(before[0]) % cells
        turn = np.arange(len(out))
        for d, place in enumerate(self.states(before), 1):
            on = np.flatnonzero(place >= 0)
            more = before[d][on] if d < len(before) else np.zeros(len(on), np.int64)
            p = place[on]
            out[on] = (self.first[d - 1][p] + mixed(np.where(more > 0, more, turn[on])) % self.many[d - 1][p]) % cells
        return out

    def spread(self, cells: int) -> list[np.ndarray]:
        """Cells that need the counts of each context, by its number over all levels: its own and those of longer ones."""
        need = [[set(((f + np.arange(m)) % cells).tolist()) for f, m in zip(fs, ms, strict=True)] for fs, ms in zip(self.first, self.many, strict=True)]
        for d in range(len(need) - 1, 0, -1):
            for code, have in zip(self.codes[d], need[d], strict=True):
                need[d - 1][int(code) >> ID_BITS] |= have
        return [np.array(sorted(x), np.int64) for level in need for x in level]


def find_hot(ids: np.ndarray, ends: np.ndarray, depth: int, share: float, tokens: int, most: int, cells: int) -> Hot:
    """Contexts that make up the share of these words, which are a sample: which contexts are hot changes where positions go, and no result."""
    before = befores(ids, ends, depth)
    levels: tuple[list, list, list, list] = ([], [], [], [])
    place = np.zeros(len(ids), np.int64)
    words = np.zeros((1, 0), np.int64)
    for word in before:
        on = np.flatnonzero((place >= 0) & (word > 0))
        codes, n = np.unique((place[on] << ID_BITS) | word[on], return_counts=True)
        hot = n >= max(2, share * len(ids))
        codes, n = codes[hot], n[hot]
        words = np.hstack([words[codes >> ID_BITS], (codes & ((1 << ID_BITS) - 1))[:, None]])
        first = mixed(mixed(codes & ((1 << ID_BITS) - 1)) + (codes >> ID_BITS) + len(levels[0])) % cells
        many = np.minimum(np.ceil(n / len(ids) * tokens / most).astype(np.int64) + 1, cells)
        for x, y in zip(levels, (codes, words, first, many), strict=True):
            x.append(y)
        if not len(codes):
            break
        code = (place << ID_BITS) | word
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        place = np.where((place >= 0) & (word > 0) & (codes[at] == code), at, -1)
    return Hot(*levels)


def deltas(x: list[np.ndarray], counts: np.ndarray, unseen: float, discount: float) -> np.ndarray:
    """For each position of one cell, log10 of its word's probability in the tree less that of the base.

    counts: of broadcast words, by id. unseen: the base's denominator. A transition or context needs two occurrences.
    """
    word, level, weight = x[WORD], x[LEVEL], x[WEIGHT]
    known = np.where(word < len(counts), counts[np.minimum(word, len(counts) - 1)], x[COUNT])
    base = np.where(word > 0, np.log10((known + 1) / unseen), 0.0)
    log = base.copy()
    level_any = level.any()
    on, group = np.arange(len(word)), np.zeros(len(word), np.int64)
    for d, before in enumerate(x[BEFORE:], 1):
        more = before[on] > 0
        on, group = on[more], group[more]
        if not len(on):
            break
        group, starts = grouped((group << ID_BITS) | before[on])
        n_groups = len(starts)
        w = weight[on]
        if level_any:
            own, sent = level[on] == 0, level[on] == d
            hot = np.bincount(group[sent], minlength=n_groups) > 0
            w = np.where(np.where(own, ~hot[group], sent), w, 0)
        c = np.bincount(group, w, n_groups)
        alive = c[group] >= 2
        on, group, w = on[alive], group[alive], w[alive]
        if not len(on):
            break
        step, first = grouped((group << ID_BITS) | word[on])
        n = np.bincount(step, w, len(first))
        owner, parent = group[first], log[on[first]]
        good = (n >= 2) & (word[on[first]] > 0)
        if not good.any():  # nor will a longer context's
            break
        o, m, up = owner[good], n[good], parent[good]
        kinds = np.bincount(o, minlength=n_groups)
        total = np.maximum(c, 1)
        rest = np.maximum(c - np.bincount(o, m, n_groups), 0)
        gamma = np.maximum((rest + discount * kinds) / total, 1e-12)
        share, upper = m / total[o], 10**up
        p = np.zeros(len(first))
        p[good] = np.log10(share - discount / total[o] + gamma[o] * upper)
        # likelihood ratio of the context's distribution (kept words and one class of all others) to its suffix's
        ratio = np.bincount(o, m * (np.log(share) - up * np.log(10)), n_groups)
        left = np.maximum(1 - np.bincount(o, upper, n_groups), 1e-12)
        ratio += np.where(rest > 0, rest * (np.log(np.maximum(rest, 1e-12) / total) - np.log(left)), 0)
        kept = ((kinds > 0) & (2 * ratio > kinds + 4 * np.sqrt(2.0 * kinds) + 4))[group]
        k, s = on[kept], step[kept]
        log[k] = np.where(good[s], p[s], log[k] + np.log10(gamma)[group[kept]])
    return log - base
