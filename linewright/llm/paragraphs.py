"""Repeated passages: MinHash banding of content-defined paragraphs.

A passage may be put anywhere in a text, so paragraphs are not lines: a word whose hash is the least within REACH words
on both sides is a boundary, and a paragraph runs from one boundary to the first that is at least LEAST_WORDS further
on. Where boundaries lie depends on nearby words only, so a passage that is long enough is cut alike in every text.

1. Each paragraph's MinHash is the sample of its least shingle hashes, each of them a band. Of n distinct shingles there
   are n - ceil(0.75 n) + 1 bands, as many as make two sets at a Jaccard of 0.75 or more share one for certain.
2. Equal paragraphs are one class. Neighbouring paragraphs of a text overlap and share bands; whether such two are alike
   is told from their places as they are cut. A band that holds nothing but one such pair, in however many texts, is done.
3. The classes of every other band are compared on their full sets. The classes of a large band are dealt anew: by the
   same number of hashes each, but those that are rarest in that band, of which two sets that are alike share one as well.
   What is still hot is compared block by block.
4. The links make components. Of each that spans several documents the first paragraph stays; the others are removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm import groups
from linewright.llm._common import released, slices
from linewright.llm.components import components
from linewright.llm.groups import joined, pairs_within, ties, whole_groups
from linewright.llm.near_dups import BROADCAST_IDS, PERCENT, SHINGLE, filling, meet_blocks, rooted
from linewright.llm.shingles import Runs, mix, text_words
from linewright.plans.lineage import Table, materialize, ship_package

REACH, LEAST_WORDS = 5, 12
#: Distinct-looking shingles that a paragraph must have: runs of one word are no passages.
LEAST_SHINGLES = 8
#: Words within which a shingle must not recur for two overlapping paragraphs to be told apart by their places.
NEARBY = 256
SLICE_BYTES = 1 << 20
#: Members of a band that are compared in one task. A large band isn't dealt anew if that leaves this share of it together.
BLOCK, TOGETHER = 8192, 0.7
#: Pairs that are compared at once.
PAIRS = 100_000


def prefix(n):
    """Of a set of n, how many of the first hashes in any order hold one that two sets that are alike share."""
    return n - (PERCENT * n + 99) // 100 + 1


class Paragraphs:
    """The paragraphs of some texts: which text, first word, word after the last (within the text) and class."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        """Of words' hashes and the count of each text's."""
        long = np.flatnonzero(counts >= LEAST_WORDS)
        self.doc = self.first = self.end = np.zeros(0, np.int64)
        self.classes = self.shingles = np.zeros(0, np.uint64)
        if not len(long):
            return
        if len(long) < len(counts):
            hashes = hashes[np.repeat(counts >= LEAST_WORDS, counts)]
            counts = counts[long]
        n = len(hashes)
        runs = Runs(hashes)
        every = np.arange(n)
        starts = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(long)), counts)
        most = np.uint64(2**64 - 1)
        padded = np.full(n + REACH * (len(long) + 1), most)
        at = every + REACH * (owner + 1)
        padded[at] = hashes
        least = np.ones(n, bool)
        for d in range(1, REACH + 1):
            least &= (hashes < padded[at - d]) & (hashes <= padded[at + d])
        least[starts] = True
        edges = np.append(np.flatnonzero(least), n)
        after = np.append(edges, 2 * n + LEAST_WORDS)
        first = edges[:-1]
        end = after[np.searchsorted(edges, first + LEAST_WORDS)]
        inside = end <= (starts + counts)[owner[first]]
        first, end = first[inside], end[inside]
        self.shingles = runs.every(SHINGLE)
        changes = np.concatenate([[0, 0], np.cumsum(self.shingles[1:] != self.shingles[:-1])])
        last = end - SHINGLE + 1
        many = changes[last] - changes[first] + 1 >= LEAST_SHINGLES
        first, end, last = first[many], end[many], last[many]
        self.at, self.last = first, last
        begins = starts[owner[first]]
        self.doc, self.first, self.end = long[owner[first]], first - begins, end - begins
        self.classes = runs(first, end - 1)

    def bands(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Band, class and other class of each band: the neighbour that has the band at the same place and isn't alike, or the class itself."""
        shingles, first, size = self.shingles, self.at, self.last - self.at
        order = np.argsort(shingles)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        place = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        sorted_ = np.sort(np.repeat(np.arange(len(first)), size) * len(order) + rank[place])
        owner, place = sorted_ // len(order), order[sorted_ % len(order)]
        hashes = shingles[place]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])
        owner, hashes, place = owner[new], hashes[new], place[new]
        distinct = np.bincount(owner, minlength=len(first))
        kept = np.arange(len(owner)) - np.repeat(np.cumsum(distinct) - distinct, distinct) < prefix(distinct)[owner]
        owner, hashes, place = owner[kept], hashes[kept], place[kept]

        # neighbours whose places tell that they are unlike: no shingle of theirs recurs nearby, and the overlap is short
        again = np.zeros(len(shingles), bool)
        again[order[1:]] = (shingles[order[1:]] == shingles[order[:-1]]) & (order[1:] - order[:-1] <= NEARBY)
        recurs = np.concatenate([[0], np.cumsum(again)])
        overlap, both = self.last[:-1] - first[1:], self.last[1:] - first[:-1]
        plain = (recurs[self.last[1:]] == recurs[first[:-1]]) & (both <= NEARBY) & (100 * overlap < PERCENT * both)
        told = np.append((overlap > 0) & plain & (self.doc[1:] == self.doc[:-1]), False)
        by_place = np.argsort(place * np.int64(len(first) + 1) + owner)
        a, b = by_place[:-1], by_place[1:]
        pair = (place[a] == place[b]) & (owner[b] == owner[a] + 1) & told[owner[a]]
        other = self.classes[owner]
        other[a[pair]] = self.classes[owner[b[pair]]]
        left = np.ones(len(owner), bool)
        left[b[pair]] = False
        return hashes[left], self.classes[owner[left]], other[left]


_BAND = T.StructType().add("bucket", "long").add("a", "long").add("b", "long")


def _bander(schema: pa.Schema):
    """Bands of the paragraphs of all texts, equal ones of a slice once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            found = Paragraphs(*text_words(part.column("text")))
            if not len(found.first):
                continue
            band, a, b = found.bands()
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.argsort(mix(band ^ mix(a + mix(b))))
            band, a, b = band[order], a[order], b[order]
            new = np.concatenate([[True], (band[1:] != band[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)) for x in (band, a, b)], schema=schema)

    return run


_CUT = T.StructType().add("doc_id", "long").add("text_key", "long").add("first", "integer").add("end", "integer").add("class", "long")


def _cutter(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            found = Paragraphs(*text_words(part.column("text")))
            if len(found.first):
                ids, keys = (part.column(c).to_numpy()[found.doc] for c in ("doc_id", "text_key"))
                columns = [ids, keys, found.first.astype(np.int32), found.end.astype(np.int32), found.classes.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return run


_MEMBER = T.StructType().add("bucket", "long").add("rep", "long").add("n", "long")


def _mixed(schema: pa.Schema):
    """Members, and their number, of each band that holds more than one pair of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            bucket, a, b = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(np.append(starts, len(bucket)))
            same = np.ones(len(starts), bool)
            for x in (a, b):
                same &= np.minimum.reduceat(x, starts) == np.maximum.reduceat(x, starts)
            on = np.repeat(~same, sizes)
            if not on.any():
                continue
            bucket, rep = np.concatenate([bucket[on], bucket[on]]), np.concatenate([a[on], b[on]])
            order = np.lexsort((rep, bucket))
            bucket, rep = bucket[order], rep[order]
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (rep[1:] != rep[:-1])])
            bucket, rep = bucket[new], rep[new]
            _, group, n = np.unique(bucket, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(rep), pa.array(n[group].astype(np.int64))], schema=schema)

    return run


_MARKED = T.StructType().add("rep", "long").add("shingles", "binary")


def _marker(schema: pa.Schema):
    """Shingle sets of the wanted paragraphs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            words, counts = text_words(part.column("text"))
            wanted = part.column("wanted")
            owner = np.repeat(np.arange(len(counts)), wanted.value_lengths().to_numpy())
            classes, first, end = (wanted.flatten().field(c).to_numpy() for c in ("class", "first", "end"))
            inside = end <= counts[owner]  # else another text has the same key
            classes, first, end, begins = classes[inside], first[inside], end[inside], (np.cumsum(counts) - counts)[owner[inside]]
            if not len(classes):
                continue
            shingles = Runs(words).every(SHINGLE)
            size = (end - first - SHINGLE + 1).astype(np.int64)
            who = np.repeat(np.arange(len(size)), size)
            hashes = shingles[np.arange(size.sum()) + np.repeat(first + begins - (np.cumsum(size) - size), size)]
            order = np.lexsort((hashes, who))
            who, hashes = who[order], hashes[order]
            new = np.concatenate([[True], (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1])])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(who[new], minlength=len(size)))])
            sets = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(hashes[new].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(classes), sets], schema=schema)

    return run


class Sets:
    """Shingle sets whose hashes are numbered in order, as one array with the start and size of each."""

    def __init__(self, column: pa.Array):
        self.sizes = np.array([len(x) // 8 for x in column.to_pylist()], np.int64)
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
        values, flat = np.unique(flat, return_inverse=True)
        self.flat, self.width = flat, len(values)
        self.marks = np.zeros(len(values), np.int64)
        self.known = np.full(len(self.sizes), -1)  # rows of equal numbers are known to be of one component
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[rows]
        who = np.repeat(np.arange(len(rows)), n)
        return who, self.flat[np.arange(n.sum()) + np.repeat(self.starts[rows] - (np.cumsum(n) - n), n)]

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of each pair, whether its sets are at least PERCENT alike."""
        n, m = self.sizes[i], self.sizes[j]
        out = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
        on = np.flatnonzero(out)
        for at in range(0, len(on), PAIRS):
            part = on[at : at + PAIRS]
            pair, x = self._of(i[part])
            left = pair * self.width + x
            pair, x = self._of(j[part])
            right = pair * self.width + x
            found = left[np.minimum(np.searchsorted(left, right), len(left) - 1)] == right
            same = np.bincount(pair[found], minlength=len(part))
            out[part] = 100 * same >= PERCENT * (n[part] + m[part] - same)
        return out

    def closure(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that make the components of some rows: each with every row that is still open."""
        _, flat = self._of(rows)
        sizes = self.sizes[rows]
        starts = np.cumsum(sizes) - sizes
        open_ = np.ones(len(rows), bool)
        found = []
        for seed in range(len(rows)):
            if not open_[seed]:
                continue
            open_[seed] = False
            reached = [seed]
            while reached:
                one = reached.pop()
                own = flat[starts[one] : starts[one] + sizes[one]]
                self.marks[own] = 1
                same = np.add.reduceat(self.marks[flat], starts)
                self.marks[own] = 0
                new = np.flatnonzero(open_ & (100 * same >= PERCENT * (sizes[one] + sizes - same)))
                open_[new] = False
                found.append(np.stack([np.full(len(new), seed), new]))
                reached += new.tolist()
            self.known[rows[found[-1][1]]] = self.known[rows[seed]] = rows[seed]
        links = np.concatenate(found, axis=1)
        return rows[links[0]], rows[links[1]]

    def among(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links that make the components of a large band's rows."""
        who, x = self._of(rows)
        values, x, times = np.unique(x, return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(values))
        key = np.sort(who * len(values) + rank[x])
        who, x = key // len(values), key % len(values)
        n = self.sizes[rows]
        rarest = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) < prefix(n)[who]
        who, x = who[rarest], x[rarest]
        order = np.argsort(x, kind="stable")
        who, x = who[order], x[order]
        starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        sizes = np.diff(np.append(starts, len(x)))
        i, j = pairs_within(starts, np.where(sizes <= groups.SMALL, sizes, 1))
        pair = np.unique(who[i] * len(rows) + who[j])
        i, j = rows[pair // len(rows)], rows[pair % len(rows)]
        on = self.alike(i, j)
        yield i[on], j[on]
        for a, m in zip(starts[sizes > groups.SMALL].tolist(), sizes[sizes > groups.SMALL].tolist(), strict=True):
            part = rows[who[a : a + m]]
            known = self.known[part]
            if known[0] >= 0 and (known == known[0]).all():
                continue
            if m > TOGETHER * len(rows):
                yield self.closure(part)
            else:
                yield from self.among(part)


def _links(schema: pa.Schema):
    """A tie for each member of a band to the first that it reaches, through members that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 2048):
            sets, bucket = Sets(batch.column(2)), batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(np.append(starts, len(bucket)))
            i, j = pairs_within(starts, np.where(sizes <= groups.SMALL, sizes, 1))
            on = sets.alike(i, j)
            found = [(i[on], j[on])]
            for a, n in zip(starts[sizes > groups.SMALL].tolist(), sizes[sizes > groups.SMALL].tolist(), strict=True):
                found += sets.among(np.arange(a, a + n))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            yield from ties(batch, joined(len(bucket), i, j), schema)

    return run


_LINK = T.StructType().add("a", "long").add("b", "long")


def _meet(pdf):
    """Links between two blocks of a band that join components which are still apart."""
    import pandas as pd

    found = []
    pdf = pdf.sort_values("side")
    n = int((pdf["side"] == 0).sum())
    if 0 < n < len(pdf):
        sets = Sets(pa.array(pdf["shingles"].tolist(), pa.binary()))
        rep = pdf["rep"].to_numpy()
        _, root = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        for i in range(n):
            apart = n + np.flatnonzero(root[n:] != root[i])
            like = apart[sets.alike(np.full(len(apart), i), apart)]
            if len(like):
                families, at = np.unique(root[like], return_index=True)
                found += [(int(rep[i]), int(rep[j])) for j in like[at]]
                root[np.isin(root, families)] = root[i]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


_ELEMENT = T.StructType().add("bucket", "long").add("rep", "long").add("most", "long").add("element", "long")


def _elements(schema: pa.Schema):
    """Every hash of each member of a band, and how many of the rarest it is dealt by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            if len(n):
                columns = [np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1)] + [np.repeat(prefix(n), n), np.concatenate(sets)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return run


def _linked(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links between members of a band. shared: bucket, rep, n; sets: rep, shingles."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def within(members: DataFrame, name: str) -> DataFrame:
        rows = members.join(sets, "rep").select("bucket", "rep", "shingles").repartition("bucket").sortWithinPartitions("bucket")
        return materialize(rows.mapInArrow(released(_links(to_arrow_schema(_LINK))), _LINK), name)

    edges = within(shared.where(F.col("n") <= BLOCK), "band-links")
    hot = shared.where(F.col("n") > BLOCK)
    if hot.isEmpty():
        return edges
    rows = hot.join(sets, "rep").select("bucket", "rep", "shingles").mapInArrow(released(_elements(to_arrow_schema(_ELEMENT))), _ELEMENT)
    rows = materialize(rows, "hot-elements")
    times = rows.groupBy("bucket", "element").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("bucket", "rep").orderBy("times", "element"))
    rarest = rows.join(times, ["bucket", "element"]).withColumn("rank", rank).where("rank <= most and times > 1")
    dealt = rarest.select(F.xxhash64("bucket", "element").alias("bucket"), "rep", F.col("times"))
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = materialize(dealt.drop("times").join(counts, "bucket"), "dealt-bands")
    edges = edges.unionByName(within(dealt.where(F.col("n") <= BLOCK), "dealt-links"))
    hot = dealt.where(F.col("n") > BLOCK)
    if hot.isEmpty():
        return edges
    part = F.pmod(F.xxhash64("rep", "bucket"), F.ceil(F.col("n") / BLOCK))
    edges = edges.unionByName(within(hot.select(F.xxhash64("bucket", part).alias("bucket"), "rep"), "block-links"))
    return meet_blocks(rooted(hot.select("bucket", "rep"), edges), sets, edges, _meet, filling(F.lit(1 / BLOCK)))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Every paragraph of docs(doc_id long, text string) whose like is in another document.

    doc_id, first_word and end_word (offsets, end exclusive), component_id (a hash), group_size (paragraphs),
    leader_doc_id (the least in the group) and removed (false for the group's first paragraph).

    Neighbouring paragraphs overlap. Null, empty and short texts (under LEAST_WORDS words) have none; very long ones are
    cut whole, like any other. Rows without an id are left out; rows that share an id are one document with each of
    their texts, and offsets count from the start of their own text; equal rows repeat their paragraphs, and the leader
    of a group is then one in each of them. Of paragraphs of the least document the first word decides, of those that
    tie in it the hash of the text. Other columns of docs are ignored, whatever their names. An empty table gives an
    empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    bands = texts.select("text").mapInArrow(released(_bander(to_arrow_schema(_BAND))), _BAND)
    members = bands.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_mixed(to_arrow_schema(_MEMBER))), _MEMBER)
    shared = Table(members, "band-members")
    found = materialize(texts.select("doc_id", "text_key", "text").mapInArrow(released(_cutter(to_arrow_schema(_CUT))), _CUT), "paragraphs")
    classes = Table(found.groupBy("class").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("copies")), "paragraph-classes")

    # the set of each class in a shared band is made from one of its places, gathered by text
    near = shared.df.select(F.col("rep").alias("class")).distinct()
    place = found.join(near, "class").groupBy("class").agg(F.min(F.struct("doc_id", "text_key", "first", "end")).alias("x"))
    wanted = place.groupBy("x.doc_id", "x.text_key").agg(F.collect_list(F.struct("class", "x.first", "x.end")).alias("wanted"))
    wanted = Table(wanted, "wanted-paragraphs")
    ids = wanted.df.select("doc_id").distinct()
    some = texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else texts
    marked = some.join(wanted.df, ["doc_id", "text_key"]).select("text", "wanted").mapInArrow(released(_marker(to_arrow_schema(_MARKED))), _MARKED)
    sets = Table(marked.dropDuplicates(["rep"]), "paragraph-sets")
    links = _linked(shared.df, sets.df)
    roots = materialize(components(links, "passages"), "passage-roots")
    for done in (shared, wanted, sets):
        done.drop()

    named = classes.df.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("component_id", F.coalesce("component", "class"))
    sums = named.groupBy("component_id").agg(F.sum("copies").alias("group_size"), F.min("low").alias("leader_doc_id"), F.max("high").alias("top")).where("leader_doc_id <> top")
    repeated = named.select("class", "component_id").join(sums.drop("top"), "component_id")
    out = materialize(found.join(repeated, "class"), "repeated-paragraphs")
    classes.drop()
    place = F.struct("first", "text_key")
    leader = out.where(F.col("doc_id") == F.col("leader_doc_id")).groupBy("component_id").agg(F.min(place).alias("leader"))
    return out.join(leader, "component_id").select(
        "doc_id", F.col("first").alias("first_word"), F.col("end").alias("end_word"), "component_id", "group_size", "leader_doc_id",
        ((F.col("doc_id") != F.col("leader_doc_id")) | (place != F.col("leader"))).alias("removed"),
    )
