"""Language-model scoring with a probabilistic suffix tree over words.

Contexts of one and more words are grown from transitions that occur twice or more in training, whatever the size of the
corpus, and a context stays only if its next-word distribution diverges from that of its suffix by a likelihood-ratio
test. Distributions are smoothed by absolute discounting into the suffix's, down to the add-one distribution over all
words. A text is scored from the longest suffix state at each word.

No one holds the tree: positions of texts are dealt by the word before them (suffix_parts.py), and each part makes its
branches and scores its positions; sums go back to the rows. What is broadcast is bounded: common words, and which
contexts are dealt over several parts. `build_tree` makes the tree as one object, for corpora whose tree one machine holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm import suffix_parts as parts
from linewright.llm._common import aside, bucket_of, released, slices, space_words
from linewright.plans.lineage import Table, materialize, ship_package

#: No word holds a space, so this one stands for the end of a text.
END = b" "
#: Shares of all tokens from which a word is a symbol, is (or ends) a context, and from which a transition is kept: two occurrences are enough at any size.
SYMBOL = CONTEXT = TRANSITION = 0.0
DEPTH, DISCOUNT = 3, 0.5
#: Words of this share of all tokens are broadcast; contexts of this share may be dealt over several cells. Neither changes a score.
COMMON, HOT = 4e-7, 1e-4
#: Positions of a cell, cells of a part, words that hot contexts are told by, positions that a task holds before it sends them.
CELL_SIZE, PART_CELLS, SAMPLE, HELD = 200_000, 8, 1_000_000, 600_000
#: What a part adds to a row's score goes back in whole multiples of 1 / UNITS, 2 ** BLOCK_BITS rows at a time.
UNITS, BLOCK_BITS = 1 << 32, 13
SLICE_BYTES, COUNTER_WORDS, HELD_CODES = 1 << 20, 250_000, 2_000_000


def _count_words(schema: pa.Schema):
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches, "text", SLICE_BYTES):
            for t in part.column("text").to_pylist():
                counts.update(space_words(t))
            counts[END] += part.num_rows
            if len(counts) > COUNTER_WORDS:
                yield out(counts)
                counts = Counter()
        if counts:
            yield out(counts)

    return run


class Level:
    """Contexts of one length: their codes (shorter context and last word), tables and back-off weights."""

    def __init__(self, contexts: np.ndarray, kept: np.ndarray, back: np.ndarray, codes: np.ndarray, logs: np.ndarray):
        self.contexts, self.kept, self.back, self.codes, self.logs = contexts, kept, back, codes, logs


def find(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sorted table, or -1."""
    if not len(table):
        return np.full(len(codes), -1, np.int64)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return np.where(table[at] == codes, at, -1)


class SuffixTree:
    """What executors need: symbols in order of their count, their log10 probabilities, and the levels of contexts."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int):
        self.ids = {w: i + 1 for i, w in enumerate(words)}
        self.width = len(words) + 1
        self.total, self.distinct = total, distinct
        self.unigram = np.concatenate([[0.0], np.log10((counts + 1) / (total + distinct + 1))])
        self.end = self.ids.get(END, 0)
        self.counts = counts
        self.levels: list[Level] = []
        self.most = int((counts >= max(2, total * CONTEXT)).sum())  # ids up to here may be in contexts

    def contexts(self, ids: np.ndarray, depth: int, open_: list[np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """For each length up to depth: the place of the context that ends at each word, or -1. Nothing crosses an end."""
        state = np.where((ids > 0) & (ids <= self.most) & (ids != self.end), ids - 1, -1)
        yield state
        tables = [level.contexts for level in self.levels[1:]] if open_ is None else open_
        for table in tables[: depth - 1]:
            before = np.concatenate([[-1], state[:-1]]) if len(state) else state
            state = np.where((before >= 0) & (ids > 0), find(table, before * self.width + ids), -1)
            yield state

    def score(self, ids: np.ndarray, stopped: np.ndarray) -> np.ndarray:
        """log10 probability of each word; a word that is no symbol has its back-off weights only. stopped: no ends."""
        out = self.unigram[ids].copy()
        for level, state in zip(self.levels, self.contexts(stopped, len(self.levels)), strict=False):
            before = np.concatenate([[-1], state[:-1]])
            on = np.flatnonzero(before >= 0)
            on = on[level.kept[before[on]]]
            at = find(level.codes, before[on] * self.width + ids[on])
            out[on] = np.where((at >= 0) & (ids[on] > 0), level.logs[at] if len(level.logs) else 0.0, out[on] + level.back[before[on]])
        return out

    def add_level(self, contexts: np.ndarray, totals: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
        """A level from its contexts' codes and counts, and its transitions' codes and counts."""
        order = np.argsort(codes)
        codes, n = codes[order], n[order].astype(float)
        owner, word = codes // self.width, codes % self.width
        parent = self._parent_logs(contexts, owner, word)
        c = totals.astype(float)
        kept_n = np.bincount(owner, n, len(c))
        kinds = np.bincount(owner, minlength=len(c))
        rest = np.maximum(c - kept_n, 0)
        gamma = (rest + DISCOUNT * kinds) / np.maximum(c, 1)
        p = np.maximum(n - DISCOUNT, 0) / np.maximum(c[owner], 1) + gamma[owner] * 10**parent
        # likelihood ratio of the context's distribution (kept words and one class of all others) to its suffix's
        ratio = np.bincount(owner, n * (np.log(n / np.maximum(c[owner], 1)) - parent * np.log(10)), len(c)).astype(float)
        left = np.maximum(1 - np.bincount(owner, 10**parent, len(c)), 1e-12)
        ratio += np.where(rest > 0, rest * (np.log(np.maximum(rest, 1e-12) / np.maximum(c, 1)) - np.log(left)), 0)
        kept = (kinds > 0) & (2 * ratio > kinds + 4 * np.sqrt(2.0 * np.maximum(kinds, 1)) + 4)
        on = kept[owner]
        self.levels.append(Level(contexts, kept, np.log10(np.maximum(gamma, 1e-12)), codes[on], np.log10(p[on])))

    def _parent_logs(self, contexts: np.ndarray, owner: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each word in the state of its context's suffix."""
        if not self.levels:
            return self.unigram[word]
        spelled = self._spell(contexts, len(self.levels) + 1)[owner][:, 1:]
        out = self.unigram[word].copy()
        for d, level in enumerate(self.levels, 1):
            tail = spelled[:, -d:]
            state = tail[:, 0] - 1
            for k, upper in enumerate(self.levels[1:d], 1):
                state = np.where(state >= 0, find(upper.contexts, state * self.width + tail[:, k]), -1)
            on = np.flatnonzero(state >= 0)
            on = on[level.kept[state[on]]]
            at = find(level.codes, state[on] * self.width + word[on])
            out[on] = np.where(at >= 0, level.logs[at] if len(level.logs) else 0.0, out[on] + level.back[state[on]])
        return out

    def _spell(self, contexts: np.ndarray, depth: int) -> np.ndarray:
        """Words of each context of a level, oldest first."""
        columns = []
        codes = contexts
        for d in range(depth - 1, 0, -1):
            columns.append(codes % self.width)
            codes = codes // self.width
            if d > 1:
                codes = self.levels[d - 1].contexts[codes]
        columns.append(codes + 1)
        return np.stack(columns[::-1], axis=1)


def _ids(tree: SuffixTree, texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text; ids of all words with ends; the place of each text's end."""
    get = tree.ids.get
    split = [space_words(t) for t in texts]
    ids: list[int] = []
    ends = []
    for words in split:
        ids += [get(w, 0) for w in words]
        ends.append(len(ids))
        ids.append(tree.end)
    return split, np.array(ids, np.int64), np.array(ends, np.int64)


def _count_transitions(sent, tables, depth: int, schema: pa.Schema):
    """Counts of (context of this length, next symbol), added up over many slices before they are shuffled."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: SuffixTree = sent.value
        held: list[np.ndarray] = []
        size = 0
        for part in slices(batches, "text", SLICE_BYTES):
            _, ids, ends = _ids(tree, part.column("text").to_pylist())
            *_, state = tree.contexts(_stopped(ids, ends), depth, tables.value)
            codes = (state[:-1] * tree.width + ids[1:])[(state[:-1] >= 0) & (ids[1:] > 0)]
            held.append(codes)
            size += len(codes)
            if size > HELD_CODES:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def _stopped(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ids with each text's end as 0, where it must not be part of a context (an end may not be a symbol at all)."""
    out = ids.copy()
    out[ends] = 0
    return out


def _counted(training: DataFrame) -> tuple[Table, int, int]:
    """The table of word, n and a number of each; the number of all tokens and of distinct ones."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(training.sparkSession)
    kind = T.StructType().add("word", "binary").add("n", "long")
    partial = training.select("text").mapInArrow(released(_count_words(to_arrow_schema(kind))), kind)
    counts = Table(partial.groupBy("word").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()), "word-counts")
    sums = counts.df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    return counts, int(sums["total"]), int(sums["distinct"])


def _rooted(counts: DataFrame, total: int, distinct: int, least: float) -> SuffixTree:
    """The tree's root: words of that many occurrences, in order of their count."""
    frequent = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    words, n = frequent.column("word").to_pylist(), frequent.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return SuffixTree([words[i] for i in order], n[order] if len(order) else np.zeros(0, np.int64), total, distinct)


def build_tree(training: DataFrame, depth: int = DEPTH) -> tuple[SuffixTree, DataFrame]:
    """The tree of training(text string) as one object, which the driver has to hold, and the table of word and count of those words that aren't symbols."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = training.sparkSession
    counts, total, distinct = _counted(training)
    least = max(2.0, total * SYMBOL)
    tree = _rooted(counts.df, total, distinct, least)
    kind = T.StructType().add("code", "long").add("n", "long")
    contexts, totals, tables = np.arange(tree.most), tree.counts[: tree.most], []
    for d in range(1, depth + 1):
        if not len(contexts):
            break
        sent, above = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(list(tables))
        found = training.select("text").mapInArrow(released(_count_transitions(sent, above, d, to_arrow_schema(kind))), kind)
        found = found.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, total * TRANSITION)).toArrow()
        sent.destroy()
        codes, n = found.column("code").to_numpy(), found.column("n").to_numpy()
        tree.add_level(contexts, totals, codes, n)
        last = codes % tree.width
        grown = (n >= max(2.0, total * CONTEXT)) & (last <= tree.most) & (last != tree.end)
        order = np.argsort(codes[grown])
        contexts, totals = codes[grown][order], n[grown][order]
        tables.append(contexts)
    return tree, counts.df.where(F.col("n") < least).select("word", "n")


def _encode(sent, keep: list[str], schema: pa.Schema):
    """Rows with their words as numbers: a broadcast word's id, or beyond them a place among the row's other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: SuffixTree = sent.value
        for part in slices(batches, "text", SLICE_BYTES):
            split, ids, ends = _ids(tree, part.column("text").to_pylist())
            starts = np.concatenate([[0], ends[:-1] + 1])
            base, known = np.add.reduceat(tree.unigram[ids], starts), np.add.reduceat((ids > 0).astype(np.int64), starts)
            codes, rare, times = [], [], []
            for words, start, end in zip(split, starts, ends, strict=True):
                own = ids[start : end + 1]
                unknown = np.flatnonzero(own == 0)
                words.append(END)  # an end that isn't broadcast is looked up like any other word
                mine = [words[i] for i in unknown.tolist()]
                places = {w: k for k, w in enumerate(dict.fromkeys(mine))}
                at = np.array([places[w] for w in mine], np.int64)
                own[unknown] = tree.width + at
                codes.append(parts.pack([parts.narrow(own)]))
                rare.append(places)
                times.append(np.bincount(at))
            lengths = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32))
            columns = [part.column(c) for c in keep] + [
                pa.array(ends - starts + 1), pa.array(known), pa.array(base), pa.array(codes, pa.binary()),
                pa.ListArray.from_arrays(lengths, pa.array([w for x in rare for w in x], pa.binary())),
                pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(times), pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


class Words:
    """What is broadcast of the words: counts by id (0: none), and for each partition of the table of counts the ids before it."""

    def __init__(self, counts: np.ndarray, before: np.ndarray):
        self.counts, self.before = counts, before

    def decode(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the rows' words with their ends (0: occurs once at most), counts of those that aren't broadcast, and each row's number of words."""
        width, found, sizes = len(self.counts), batch.column("_found"), batch.column("_size").to_numpy()
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
        ids = parts.unpack(batch.column("_codes").to_pylist(), 1, sizes.tolist())[0].astype(np.int64)
        counts = np.zeros(len(ids), np.int64)
        others = np.maximum(np.maximum.reduceat(ids, np.cumsum(sizes) - sizes) - width + 1, 0)  # of each row, words that aren't broadcast
        offsets = np.cumsum(others) - others
        flat = found.flatten()
        places, number, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        table = np.zeros((2, int(others.sum())), np.int64)
        table[:, places + np.repeat(offsets, found.value_lengths().to_numpy(zero_copy_only=False))] = self.before[number >> 33] + (number & ((1 << 33) - 1)) + width, n
        rare = np.flatnonzero(ids >= width)
        at = ids[rare] - width + np.repeat(offsets, sizes)[rare]
        ids[rare], counts[rare] = table[:, at]
        return ids, counts, sizes


def _held(words: Words, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Many rows' ids, counts and ends, and of each row its number (0: not asked for) and whether it is in training."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for part in _cut(batch, max(1, most // 4)):
            ids, counts, sizes = words.decode(part)
            row = np.where(part.column("_out").to_numpy(zero_copy_only=False).astype(bool), part.column("_row").to_numpy() + 1, 0)
            held.append((ids, counts, sizes, row, part.column("_train").to_numpy(zero_copy_only=False).astype(np.int64)))
            size += len(ids)
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _cut(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of so many words at most, or of one row."""
    place = np.cumsum(batch.column("_size").to_numpy()) // most
    cuts = [*np.flatnonzero(np.diff(place, prepend=-1)), len(place)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _joined(held: list[tuple]) -> tuple[np.ndarray, ...]:
    ids, counts, sizes, rows, train = (np.concatenate(x) for x in zip(*held, strict=True))
    return ids, counts, np.cumsum(sizes) - 1, rows, train


def _count_hot(sent, depth: int, most: int, schema: pa.Schema):
    """Counts of words after each hot context, in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot = sent.value
        for ids, counts, ends, _, _ in _held(words, batches, most):
            for offset, place in zip(hot.offsets, hot.states(parts.befores(ids, ends, depth)), strict=False):
                on = np.flatnonzero(place >= 0)
                group, first = parts.grouped(((place[on] + offset) << parts.ID_BITS) | ids[on])
                if len(on):
                    at = on[first]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[at] + offset, ids[at], counts[at], np.bincount(group))], schema=schema)

    return run


def _deal(sent, depth: int, cells: int, per: int, most: int, schema: pa.Schema):
    """Positions by the part that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot = sent.value
        for ids, counts, ends, rows, train in _held(words, batches, most):
            before = parts.befores(ids, ends, depth)
            on = np.flatnonzero(before[0] > 0)
            before = [x[on] for x in before]
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))[on]
            cell = hot.cells(before, cells)
            yield from _sent([cell, rows[owner], np.zeros_like(cell), train[owner], ids[on], counts[on], *before], per, schema)

    return run


def _deal_hot(sent, depth: int, cells: int, per: int, schema: pa.Schema):
    """Counts of hot contexts, for every cell that has positions of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot = sent.value
        need = hot.spread(cells)
        for batch in batches:
            contexts, word, count, n = (batch.column(k).to_numpy() for k in range(4))
            for context in np.unique(contexts):
                mine = np.flatnonzero(contexts == context)
                level = int(np.searchsorted(hot.offsets, context, side="right"))
                spelled = hot.words[level - 1][context - hot.offsets[level - 1]]
                where, masks = np.unique(need[context] // per, return_inverse=True)
                masks = np.bincount(masks, 1 << need[context] % per).astype(np.int64)  # a bit for each cell of the part
                for part, mask in zip(where, masks, strict=True):
                    full = [np.full(len(mine), x, np.int64) for x in (mask, 0, level)]
                    before = [np.full(len(mine), spelled[d] if d < level else 0, np.int64) for d in range(depth)]
                    packed = parts.pack([*full, n[mine], word[mine], count[mine], *before])
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(mine)]), pa.array([packed], pa.binary())], schema=schema)

    return run


def _sent(columns: list[np.ndarray], per: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns cut by part. Each part's are in order of their cells, and the cell is that in the part."""
    cell = columns[parts.CELL]
    order = np.argsort(cell.astype(np.uint16) if len(cell) and cell.max() < 1 << 16 else cell, kind="stable")
    part = cell[order] // per
    columns = [parts.narrow(x)[order] for x in (cell % per, *columns[1:])]
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
    packed = [parts.pack([x[a:b] for x in columns]) for a, b in zip(cuts, cuts[1:], strict=False)]
    yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(packed, pa.binary())], schema=schema)


def _score_part(sent, depth: int, unseen: float):
    """Sums over the positions of each row, cell by cell."""

    def run(table: pa.Table) -> pa.Table:
        words, _ = sent.value
        columns = parts.unpack(table.column("packed").to_pylist(), parts.BEFORE + depth, table.column("size").to_pylist())
        own, hot = np.flatnonzero(columns[parts.LEVEL] == 0), np.flatnonzero(columns[parts.LEVEL])
        place, masks = columns[parts.CELL][own], columns[parts.CELL][hot]
        own = own[np.argsort(place.astype(np.uint16), kind="stable")]
        rows, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for k, mine in enumerate(np.split(own, np.cumsum(np.bincount(place))[:-1])):
            mine = np.concatenate([mine, hot[masks >> k & 1 > 0]])
            cell = [x[mine].astype(np.int64) for x in columns]
            log = parts.deltas(cell, words.counts, unseen, DISCOUNT)
            asked = cell[parts.ROW] > 0
            row, log = cell[parts.ROW][asked], log[asked]
            group, first = parts.grouped(row)
            rows.append(row[first])
            sums.append(np.bincount(group, log, len(first)))
        row, log = np.concatenate(rows), np.concatenate(sums)
        group, first = parts.grouped(row)
        row, units = row[first] - 1, np.zeros(len(first), np.int64)
        np.add.at(units, group, np.rint(log * UNITS).astype(np.int64))
        block = row >> BLOCK_BITS
        cuts = [*np.flatnonzero(np.diff(block, prepend=-1)), len(row)]
        packed = [parts.pack([parts.narrow(row[x:y] - (block[x] << BLOCK_BITS)), units[x:y] << 1 ^ units[x:y] >> 63]) for x, y in zip(cuts, cuts[1:], strict=False)]
        out = pa.table({"block": pa.array(block[cuts[:-1]], pa.int64()), "size": pa.array(np.diff(cuts), pa.int64()), "packed": pa.array(packed, pa.binary())})
        pa.default_memory_pool().release_unused()
        return out

    return run


def _sum_block(table: pa.Table) -> pa.Table:
    """Sums of the parts' sums, for the rows of a block. They are whole numbers, so their order changes nothing."""
    sums, seen = np.zeros(1 << BLOCK_BITS, np.int64), np.zeros(1 << BLOCK_BITS, bool)
    for packed, size in zip(table.column("packed"), table.column("size").to_pylist(), strict=True):
        row, units = parts.unpack([packed.as_py()], 2, [size])
        sums[row] += (units >> 1) ^ -(units & 1)  # a part has each row once
        seen[row] = True
    row = np.flatnonzero(seen)
    return pa.table({"_row": pa.array(row + (table.column("block")[0].as_py() << BLOCK_BITS), pa.int64()), "_delta": pa.array(sums[row] / UNITS, pa.float64())})


def _deltas(coded: DataFrame, words: Words, unseen: float, depth: int) -> DataFrame:
    """_row and _delta of coded(_row, _train, _out, _size, _codes, _found): what contexts add to the base score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = coded.sparkSession
    tokens = coded.agg(F.sum("_size")).first()[0]
    cells = -(-tokens // CELL_SIZE)
    sample = coded.sample(min(1.0, SAMPLE / tokens), 0).select("_codes", "_size", "_found").toArrow().combine_chunks().to_batches()
    seen = [words.decode(batch) for batch in sample]
    ids, sizes = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in seen]]) for k in (0, 2))
    ends = np.cumsum(sizes) - 1
    hot = parts.find_hot(ids, ends, depth, max(CELL_SIZE / tokens, HOT), tokens, CELL_SIZE, cells)
    sent = spark.sparkContext.broadcast((words, hot))
    kind = T.StructType().add("part", "long").add("size", "long").add("packed", "binary")
    dealt = coded.mapInArrow(released(_deal(sent, depth, cells, PART_CELLS, HELD, to_arrow_schema(kind))), kind)
    done: list[Table] = []
    if hot.offsets[-1]:
        counted = T.StructType([T.StructField(c, T.LongType()) for c in ("context", "word", "count", "n")])
        found = coded.where("_train").mapInArrow(released(_count_hot(sent, depth, HELD, to_arrow_schema(counted))), counted)
        found = found.groupBy("context", "word").agg(F.max("count").alias("count"), F.sum("n").alias("n"))
        once = F.col("n") < 2  # these are only in the sum of what follows a context
        found = found.groupBy("context", F.when(once, 0).otherwise(F.col("word")).alias("word")).agg(F.max(F.when(once, 0).otherwise(F.col("count"))).alias("count"), F.sum("n").alias("n"))
        done.append(Table(found.sortWithinPartitions("context"), "hot-counts"))
        dealt = dealt.union(done[0].df.mapInArrow(released(_deal_hot(sent, depth, cells, PART_CELLS, to_arrow_schema(kind))), kind))
    sums = dealt.groupBy("part").applyInArrow(_score_part(sent, depth, unseen), T.StructType().add("block", "long").add("size", "long").add("packed", "binary"))
    out = materialize(sums.groupBy("block").applyInArrow(_sum_block, T.StructType().add("_row", "long").add("_delta", "double")), "row-scores")
    sent.destroy()  # else Python workers keep it
    for table in done:
        table.drop()
    return out


def lm_scores(docs: DataFrame, training: DataFrame, depth: int = DEPTH) -> DataFrame:
    """All columns of docs but the text, n_tokens, n_known, train_tokens, base_score and score.

    A null text is an empty one: its end is its only token. Texts of any length are scored whole. Rows are independent,
    repeated ones and rows without an id included; symbols of equal counts are ordered by their bytes, which changes no
    score. Columns of docs that clash with those added are replaced, all others keep their names and values. Without training texts every score is that of
    an empty count table (0).
    """
    rows = docs.withColumn("text", F.col("text").cast("string"))
    own = [c for c in docs.columns if c != "text"]
    rows, back = aside(rows, OWN)
    names = dict(zip(docs.columns, rows.columns, strict=True))
    flags = lambda train: (F.lit(train).alias("_train"), F.lit(not train).alias("_out"))
    others = [F.lit(None).cast(rows.schema[names[c]].dataType).alias(names[c]) for c in own]
    keep = [names[c] for c in own]
    both = rows.select(*[F.col(f"`{c}`") for c in keep], "text", *flags(False)).union(training.select(*others, F.col("text").cast("string").alias("text"), *flags(True)))
    return _scored(both, training, dict(zip(docs.columns, back, strict=True)), names, depth)


#: Columns that lm_scores works with.
OWN = ("_rare", "_times", "_row", "_log", "_known", "_train", "_out", "_codes", "_size", "_found", "_delta", "_rare_log", "_rare_known")


def _scored(rows: DataFrame, training: DataFrame, back: dict, names: dict[str, str], depth: int) -> DataFrame:
    """lm_scores of rows with _train and _out, whether a row is in training and whether it is asked for. back: expressions of the columns by their names; names: as which they are in rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    counts, total, distinct = _counted(training)
    least = max(2.0, total * COMMON)
    tree = _rooted(counts.df, total, distinct, least)  # at most 1 / COMMON words
    added = T.StructType().add("n_tokens", "long").add("n_known", "long").add("base_score", "double")
    hidden = T.StructType().add("_size", "long").add("_known", "long").add("_log", "double").add("_codes", "binary")
    extra = T.StructType().add("_rare", T.ArrayType(T.BinaryType())).add("_times", T.ArrayType(T.LongType()))
    outer = [c for c in names if c not in ("text", "train_tokens", "score", *added.fieldNames())]
    keep = [*[names[c] for c in outer], "_train", "_out"]
    schema = T.StructType([rows.schema[c] for c in keep] + hidden.fields + extra.fields)
    sent = spark.sparkContext.broadcast(tree)
    coded = rows.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(released(_encode(sent, keep, to_arrow_schema(schema))), schema)
    coded = Table(coded.withColumn("_row", F.monotonically_increasing_id()), "coded-rows")
    sent.destroy()

    rare = coded.df.select("_row", F.posexplode(F.arrays_zip("_rare", "_times")).alias("_at", "x")).select("_row", "_at", F.col("x._rare").alias("word"), F.col("x._times").alias("times"))
    joined = rare.join(counts.df.where(F.col("n") < least).hint("shuffle_hash"), "word", "left")
    unseen = float(total + distinct + 1)
    log = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(unseen))
    sums = joined.groupBy("_row").agg(
        F.sum(F.col("times") * log).alias("_rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_rare_known"),
        F.collect_list(F.when(F.col("n") >= 2, F.struct("_at", "id", "n"))).alias("_found"),
    )
    resolved = coded.df.drop("_rare", "_times").join(sums.hint("shuffle_hash"), "_row", "left").withColumns({
        "_known": F.col("_known") + F.coalesce("_rare_known", F.lit(0)), "_log": F.col("_log") + F.coalesce("_rare_log", F.lit(0.0)),
        "_found": F.coalesce("_found", F.array().cast("array<struct<_at:int,id:bigint,n:bigint>>")),
    })
    resolved = materialize(resolved.drop("_rare_log", "_rare_known"), "scored-rows")
    coded.drop()
    out = resolved.where("_out")
    if total:
        ends = {r["p"]: r["n"] for r in counts.df.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        counts.drop()
        before = np.cumsum([0, *[ends.get(p, 0) for p in range(max(ends))]]).astype(np.int64)
        words = Words(np.concatenate([[0], tree.counts]).astype(np.int64), before)
        out = out.join(_deltas(resolved.select("_row", "_train", "_out", "_size", "_codes", "_found"), words, unseen, depth), "_row", "left")
    else:
        out = out.withColumn("_delta", F.lit(0.0))
    return out.select(
        *[back[c] for c in outer], F.col("_size").alias("n_tokens"), F.col("_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.col("_log").alias("base_score"), (F.col("_log") + F.coalesce("_delta", F.lit(0.0))).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; fold 2 of 7 is held out of training."""
    held = bucket_of("doc_id", 7) == 2
    rows = docs.select("doc_id", "text", held.alias("held_out"), (~held).alias("_train"), F.lit(True).alias("_out"))
    names = ("doc_id", "held_out")
    return _scored(rows, docs.where(~held), {c: F.col(c) for c in names}, {c: c for c in names}, DEPTH)
