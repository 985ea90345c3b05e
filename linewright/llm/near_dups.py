"""MinHash near-duplicates with odd sketches.

1. Each text becomes the set of its distinct five-word shingles, 128 MinHash samples of it, 32 band keys of four samples
   each, and an odd sketch: a 1024-bit map in which every sample flips one bit. Texts with equal sets are one class, told
   by a hash of the set.
2. Within a bucket (one band key), classes that their sketches find similar are tied, directly or through others: the
   count of bits in the XOR of two sketches estimates how many samples differ. Large buckets are dealt into blocks; then
   block meets block, for classes whose families are still apart, so no task holds more than two blocks and no pair of a
   bucket is left out.
3. The ties make families (connected components). Within a family, every pair that the sketches don't rule out and that
   isn't yet connected is checked on the full sets; large families are dealt into blocks, and block meets block as above.
4. The links found make components; a document's component is the least doc_id that it reaches.

No step emits the pairs of a group: each row out of a task is a class's tie or a link that joins two components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm._common import released, slices
from linewright.llm.components import components
from linewright.llm.groups import group_roots, ties, whole_groups
from linewright.llm.shingles import min_hashes, mix, shingle_sets, text_words
from linewright.plans.lineage import in_few_files, materialize, ship_package

SHINGLE, PERCENT = 5, 75
SAMPLES, ROWS, BITS = 128, 4, 1024
#: An estimate below this is no tie in a bucket and no candidate in a family: at a similarity of 0.75 an estimate has a
#: standard deviation of about 0.05.
CANDIDATE = 0.5
#: Members of a bucket in a block; members and shingles of a family in a block.
BUCKET_BLOCK, FAMILY_BLOCK, BLOCK_SHINGLES = 2048, 2000, 2_000_000
#: A full block, in the units that members' sizes are added up in.
FULL = 1_000_000_000
SLICE_BYTES = 1 << 20
#: Ids that may be broadcast, at most; more are joined by a shuffle of the texts.
BROADCAST_IDS = 500_000
#: Rows of a part: of bands, of those that are compared by sketches, and of whole sets.
BAND_ROWS, TIED_ROWS, SET_ROWS = 200_000, 10_000, 1_000
#: Pairs of sketches that are compared at once.
PAIRS = 20_000
_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64)
_SALT = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Row i: the parity bitmap of row i of samples, as 64-bit words."""
    n = len(samples)
    at = (mix(samples ^ _SALT) >> np.uint64(54)).astype(np.int64) + np.arange(n)[:, None] * BITS
    parity = (np.bincount(at.ravel(), minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(parity, axis=1).view(np.uint64)


def estimates(sketch: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Similarity of one set to others, from their odd sketches."""
    differ = np.minimum(np.bitwise_count(sketches ^ sketch).sum(axis=1), BITS // 2 - 1)
    return 1 + BITS / 2 * np.log(1 - 2 * differ / BITS) / (2 * SAMPLES)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(len(samples), -1, ROWS)
    key = np.zeros(rows.shape[:2], np.uint64) + np.arange(rows.shape[1], dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key ^ rows[:, :, i])
    return key


def classes_of(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; no set is empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets], np.uint64)
    return mix(np.add.reduceat(flat, starts) + mix(np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts) + sizes))


_SIGNATURE = T.StructType().add("doc_id", "long").add("n_shingles", "long").add("rep", "long").add("bands", T.ArrayType(T.LongType(), False)).add("sketch", "binary")


def _signatures(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(*text_words(part.column("text")), SHINGLE)
            full = [i for i, s in enumerate(sets) if len(s)]
            classes: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            if full:
                own = [sets[i] for i in full]
                samples = min_hashes(own, _A, _B)
                for i, c, b, s in zip(full, classes_of(own).view(np.int64).tolist(), band_keys(samples).view(np.int64), odd_sketches(samples), strict=True):
                    classes[i], bands[i], marks[i] = c, b, s.tobytes()
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())).cast(schema.field("bands").type), pa.array(marks, pa.binary()),
            ], schema=schema)

    return run


_SET = T.StructType().add("rep", "long").add("shingles", "binary")


def _shingles(schema: pa.Schema):
    """Class and set of each text that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            sets = [s for s in shingle_sets(*text_words(part.column("text")), SHINGLE) if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(classes_of(sets).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


def _words64(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def in_runs(df: DataFrame, keys: list[str], each: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """each(rows) for the rows of every key, as a grouped function would, but in batches that short groups share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for pdf in batches:
            if not len(pdf):
                continue
            values = [pdf[k].to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)], strict=True):
                own = tuple(v[a] for v in values)
                if own != key and held:
                    out.append(each(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                key = own
                held.append(pdf.iloc[a:b])
            if out:
                yield pd.concat(out)
        if held:
            yield each(pd.concat(held) if len(held) > 1 else held[0])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


_TIE = T.StructType().add("a", "long").add("b", "long")


def _alike(schema: pa.Schema):
    """Ties of buckets, or blocks of them: each member to the first that its sketch reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 2048):
            sketches = _words64(batch.column(2).to_pylist())

            def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                parts = [estimates(sketches[i[a : a + PAIRS]], sketches[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]
                return np.concatenate([*parts, np.zeros(0)]) >= CANDIDATE

            like = lambda one, a, n: estimates(sketches[one], sketches[a : a + n]) >= CANDIDATE
            yield from ties(batch, group_roots(batch.column(0).to_numpy(), alike, like), schema)

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ties between two blocks of a bucket that join families which are still apart."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        _, code = np.unique(np.concatenate([left["root"].to_numpy(), right["root"].to_numpy()]), return_inverse=True)
        own, other = code[: len(left)].copy(), code[len(left) :].copy()
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        x, y = _words64(left["sketch"]), _words64(right["sketch"])
        for i in range(len(a)):
            apart = np.flatnonzero(other != own[i])
            like = apart[estimates(x[i], y[apart]) >= CANDIDATE]
            if len(like):
                joined, first = np.unique(other[like], return_index=True)
                found += [(int(a[i]), int(b[j])) for j in like[first]]
                mine = own[i]
                own[np.isin(own, joined)] = mine
                other[np.isin(other, joined)] = mine
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


class _Members:
    """Sets and sketches of a block's members. Hashes are numbered once, so that a set is checked by marks, not searches."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids = pdf["rep"].to_numpy()
        self.sketches = _words64(pdf["sketch"])
        self.sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.universe, local = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.local = np.split(local.astype(np.int32), np.cumsum(self.sizes)[:-1])
        self.marks = np.zeros(len(self.universe), np.int32)

    def linked(self, one: np.ndarray, sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Those of the other members (places) whose full set is at least PERCENT like the one set."""
        n, m = len(one), self.sizes[others]
        others = others[100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)]
        if len(others):
            others = others[estimates(sketch, self.sketches[others]) >= CANDIDATE]
        if not len(others):
            return others
        at = np.minimum(np.searchsorted(self.universe, one), len(self.universe) - 1)
        at = at[self.universe[at] == one]
        self.marks[at] = 1
        starts = np.concatenate([[0], np.cumsum(self.sizes[others])[:-1]])
        same = np.add.reduceat(self.marks[np.concatenate([self.local[i] for i in others])], starts)
        self.marks[at] = 0
        return others[100 * same >= PERCENT * (n + self.sizes[others] - same)]


def _within(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact components of one block of a family: each member tied to the block's root of it."""
    m = _Members(pdf.sort_values("rep"))
    open_ = np.ones(len(m.ids), bool)
    root = m.ids.copy()
    for seed in range(len(m.ids)):
        if not open_[seed]:
            continue
        open_[seed] = False
        reached = [seed]
        while reached:
            at = reached.pop()
            new = m.linked(m.sets[at], m.sketches[at], np.flatnonzero(open_))
            open_[new] = False
            root[new] = m.ids[seed]
            reached += new.tolist()
    return pd.DataFrame({"a": root, "b": m.ids})


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of a family that join components which are still apart."""
    pdf = pdf.sort_values("rep")
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    parent = {r: r for r in pdf["root"]}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        a, b = _Members(left), _Members(right)
        roots = right["root"].to_numpy()
        names = list(dict.fromkeys(roots.tolist()))
        for i, own in enumerate(left["root"].tolist()):
            mine = find(own)
            apart = [r for r in names if find(r) != mine]
            if not apart:
                continue
            for j in b.linked(a.sets[i], a.sketches[i], np.flatnonzero(np.isin(roots, apart))).tolist():
                x, y = find(own), find(int(roots[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((own, int(roots[j])))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def filling(share: Column) -> Column:
    """The share of a block as a whole number, so that sums don't depend on their order."""
    return F.ceil(share * FULL).cast("long")


def meet_blocks(members: DataFrame, payload: DataFrame, edges: DataFrame, meet: Callable[[pd.DataFrame], pd.DataFrame], size: Column) -> DataFrame:
    """The edges with those that meet(rows) finds between blocks of buckets, for members whose roots differ.

    members: bucket, rep and root (of what is known to belong together); payload: rep and what meet needs; size: the
    billionths of a block that a member fills. Members of a bucket's largest root need not meet one another, so every other member
    meets every block. meet gets side 0 (a block of all) and side 1 (a block of the others).
    """
    members = materialize(members.withColumn("size", size), "hot-members")
    sizes = members.groupBy("bucket", "root").agg(F.sum("size").alias("s"))
    largest = sizes.groupBy("bucket").agg(F.sum("s").alias("all"), F.max(F.struct("s", "root")).alias("x"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    count = lambda c: F.ceil(c / FULL).cast("int")
    largest = largest.select("bucket", F.col("x.root").alias("most"), count(F.col("all")).alias("rows"), count(F.col("all") - F.col("x.s")).alias("columns"))
    placed = members.join(largest, "bucket")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    one = placed.select("bucket", dealt("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), "rep", "root")
    other = placed.where("root <> most").select("bucket", every("rows").alias("i"), dealt("columns").alias("j"), F.lit(1).alias("side"), "rep", "root")
    met = one.unionByName(other).join(payload, "rep")
    return edges.unionByName(materialize(in_runs(met, ["bucket", "i", "j"], meet, "a long, b long"), "block-links"))


def _ties(shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold all members of a bucket that are like each other. shared: bucket, rep, n (size of the bucket)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    # a member is in another block in each of its buckets, so what is alike finds together at once, as a rule
    block = F.pmod(F.xxhash64("rep", "bucket"), F.ceil(F.col("n") / BUCKET_BLOCK))
    blocks = shared.select(F.when(F.col("n") > BUCKET_BLOCK, F.xxhash64("bucket", block)).otherwise(F.col("bucket")).alias("block"), "rep")
    dealt = blocks.join(sketches, "rep").select("block", "rep", "sketch").repartition("block").sortWithinPartitions("block")
    edges = materialize(in_few_files(dealt.mapInArrow(released(_alike(to_arrow_schema(_TIE))), _TIE), shared.count(), TIED_ROWS), "ties")
    hot = shared.where(F.col("n") > BUCKET_BLOCK).select("bucket", "rep")
    if hot.isEmpty():
        return edges
    return meet_blocks(rooted(hot, edges), sketches, edges, _meet, filling(F.lit(1 / BUCKET_BLOCK)))


def rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with root, the component of rep."""
    roots = components(edges, "roots", edges.count()).select(F.col("node").alias("rep"), "component")
    return members.join(roots, "rep", "left").withColumn("root", F.coalesce("component", "rep")).drop("component")


def exact_links(shared: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) whose components are those of all links between members that share a bucket.

    shared: bucket, rep and n (members of the bucket); sketches: rep and sketch; sets_of: for a table of reps (those in a
    family), their rep and shingles (sorted distinct 64-bit hashes, as bytes).
    """
    edges = _ties(shared, sketches)
    families = components(edges, "families", edges.count()).select(F.col("node").alias("rep"), F.col("component").alias("bucket"))
    families = materialize(in_few_files(families, sketches.count()), "families")
    n = families.count()
    sets = materialize(in_few_files(sets_of(families.select("rep")), n, SET_ROWS), "sets")
    load = filling(F.greatest(F.lit(1 / FAMILY_BLOCK), F.length("shingles") / (8 * BLOCK_SHINGLES)))
    sized = materialize(in_few_files(families.join(sets.select("rep", load.alias("load")), "rep"), n), "sized-families")
    blocks = sized.groupBy("bucket").agg(F.ceil(F.sum("load") / FULL).cast("int").alias("blocks"))
    placed = sized.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    payload = sets.join(sketches, "rep")
    inner = in_runs(placed.select("bucket", "block", "rep").join(payload, "rep"), ["bucket", "block"], _within, "a long, b long")
    links = materialize(in_few_files(inner, n, SET_ROWS), "links")
    split = placed.where("blocks > 1").select("bucket", "rep", "load")
    if split.isEmpty():
        return links
    return meet_blocks(rooted(split, links), payload, links, _between, F.col("load"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id long, text string).

    Null and empty texts have an empty set and are linked with nothing. Rows that share a doc_id are one document with
    each of their texts: what any of them is linked with is linked with all. A row without a doc_id takes no part: its
    component_id is null and it is kept. Texts of any length are taken whole; of tied members the least doc_id names the
    component. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(texts.mapInArrow(released(_signatures(to_arrow_schema(_SIGNATURE))), _SIGNATURE), "signatures")
    rows = signed.count()
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    copies = usable.groupBy("rep").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    copies = materialize(in_few_files(copies, rows), "copies")
    # one row of each class: its only one, or one of its least document
    told = usable.join(copies, "rep", "left").select("rep", "doc_id", "low", "bands", "sketch")
    reps = told.where("low is null").unionByName(told.where("low = doc_id").dropDuplicates(["rep"])).drop("low")

    members = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(in_few_files(members.join(sizes, "bucket"), rows * SAMPLES // ROWS, BAND_ROWS), "shared-buckets")
    involved = materialize(in_few_files(reps.select("rep", "doc_id", "sketch").join(shared.select("rep").distinct(), "rep", "left_semi"), rows), "sketches")

    def sets_of(families: DataFrame) -> DataFrame:
        ids = materialize(in_few_files(involved.join(families, "rep", "left_semi").select("doc_id").distinct(), rows), "family-ids")
        few = ids.count() <= BROADCAST_IDS
        sets = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text").mapInArrow(released(_shingles(to_arrow_schema(_SET))), _SET)
        return sets.join(families, "rep", "left_semi").dropDuplicates(["rep"])

    links = exact_links(shared, involved.select("rep", "sketch"), sets_of)
    # documents with several texts tie the classes of these together
    several = usable.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("doc_id")
    tied = usable.join(several, "doc_id").select("doc_id", "rep")
    own = tied.join(tied.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
    roots = materialize(in_few_files(components(links.unionByName(own), "near", rows).withColumnRenamed("node", "rep"), rows), "near-roots")
    least = usable.select("rep", "doc_id").join(roots, "rep").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(least, "component").select("rep", "component_id")
    named = named.unionByName(copies.join(roots, "rep", "left_anti").select("rep", F.col("low").alias("component_id")))
    named = materialize(in_few_files(named, rows), "named-classes")

    full = usable.join(named, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    other = full.join(rest.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rest = rest.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.unionByName(rest).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns: of each group the one of least doc_id.

    Rows that share the kept doc_id all stay.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
