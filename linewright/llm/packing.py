"""Sharding by best-fit-decreasing bin packing of groups of equal texts.

Groups are indivisible. Their sizes are gathered into classes (exact up to 4,095 bytes, within 1/2048 beyond), so that
what the packer sees has a size fixed beforehand, however many groups there are: at most about 110,000 classes. Classes
come in decreasing order of size; each run of equal items goes into the bin with the tightest room that still takes
one, found in a balanced search tree, until that bin is full. The least capacity with which the given number of bins
suffices is found by bisection, so all bins end nearly equal. A group larger than a fair share has a bin of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm._common import aside
from linewright.plans.lineage import materialize

OVERHEAD = 16
#: Leading bits of a group's size that its class keeps.
CLASS_BITS = 12
#: Rows in a run of slots that is numbered in one task.
RUN_ROWS = 200_000


class RoomTree:
    """A treap of (room, bin), for the tightest bin that takes an item."""

    __slots__ = ("root", "_seed")

    def __init__(self) -> None:
        self.root = None
        self._seed = 12345

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, room: int, bin_: int) -> None:
        self._seed = (self._seed * 1103515245 + 12345) & 0x7FFFFFFF
        node = [(room, bin_), self._seed, None, None]
        left, right = self._split(self.root, (room, bin_))
        self.root = self._join(self._join(left, node), right)

    def remove(self, room: int, bin_: int) -> None:
        left, rest = self._split(self.root, (room, bin_))
        _, right = self._split(rest, (room, bin_ + 1))
        self.root = self._join(left, right)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (room, bin) with room for size."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found


def best_fit(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (place of the class, bin, items) of classes (size, items) in decreasing size; None if over `most` bins."""
    tree, opened, runs = RoomTree(), 0, []
    for place, (size, items) in enumerate(classes):
        while items:
            found = tree.tightest(size)
            if found is None:
                if opened == most:
                    return None
                room, bin_ = max(capacity, size), opened
                opened += 1
            else:
                room, bin_ = found
                tree.remove(room, bin_)
            n = min(items, room // size)
            runs.append((place, bin_, n))
            items -= n
            tree.add(room - n * size, bin_)
    return runs


def pack(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Runs with which the classes fill the bins most evenly: the least capacity that best fit can do with."""
    alone, left, total = [], bins, sum(s * n for s, n in classes)
    rest = list(classes)
    while rest and left > 1 and rest[0][0] * left > total:  # larger than a fair share of what is left
        size, n = rest[0]
        alone.append((len(classes) - len(rest), bins - left, 1))
        left, total = left - 1, total - size
        rest[0:1] = [(size, n - 1)] if n > 1 else []
    if not rest:
        return alone
    skipped = len(classes) - len(rest)
    low = max(-(-total // left), rest[0][0])
    high, best = low, None
    step = max(1, low // 4096)
    while (best := best_fit(rest, high, left)) is None:
        low, high, step = high + 1, high + step, step * 2
    while high - low > max(1, high // 100_000):
        middle = (low + high) // 2
        if (found := best_fit(rest, middle, left)) is None:
            low = middle + 1
        else:
            best, high = found, middle
    return alone + [(p + skipped, b + bins - left, n) for p, b, n in best]


def size_class(size: Column) -> Column:
    """The size, rounded up to a number with at most CLASS_BITS leading bits."""
    extra = F.greatest(F.lit(0), F.length(F.bin(size)) - CLASS_BITS)
    unit = F.pow(F.lit(2.0), extra).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All columns of docs, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null: no such law holds).

    size is the text's UTF-8 bytes plus 16; a null text counts as an empty one. Equal
    texts are in one shard, and groups over 4,095 bytes are packed by a size rounded up by less than 1/2048, so that shards differ by
    that much more, at most, than exact sizes would let them. Slots of a shard run from 0 without gaps; rows that are equal in all columns used (repeated
    rows) are interchangeable. Columns of docs that clash with those added are replaced. An empty table gives an empty
    table; shards without rows don't appear.
    """
    spark = docs.sparkSession
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs, back = aside(docs.select(*[c for c in docs.columns if c.lower() not in added and c.lower() != "text"], "text"), ("_key", "_hot", "_run", "_r", "_first"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.withColumns({"size": (F.length(raw) + OVERHEAD).cast("long"), "text_crc32": F.crc32(raw), "_key": F.md5(raw)})
    light = materialize(sized.drop("text"), "shard-rows")

    groups = light.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    groups = groups.withColumn("class", size_class(F.col("bytes")))
    # within a class, groups are numbered by class and part of their hash, so that a common class is no single task
    part = F.substring("_key", 1, 2)
    groups = materialize(groups.withColumn("part", part), "shard-groups")
    counts = groups.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = sorted(((r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    runs = pack(histogram, shards)

    # the runs of a class, as the ranks at which each begins
    begins: dict[int, list[tuple[int, int]]] = {}
    seen: dict[int, int] = {}
    for place, bin_, n in runs:
        begins.setdefault(place, []).append((seen.get(place, 0), bin_))
        seen[place] = seen.get(place, 0) + n
    plan = spark.createDataFrame(
        [(histogram[p][0], [b for b, _ in x], [s for _, s in x]) for p, x in begins.items()], "class long, begins array<long>, bins array<int>"
    )
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = groups.withColumn("r", F.row_number().over(Window.partitionBy("class", "part").orderBy("_key")) - 1)
    ranked = ranked.join(offsets.select("class", "part", F.coalesce("offset", F.lit(0)).alias("offset")), ["class", "part"])
    rank = F.col("r") + F.col("offset")
    ranked = ranked.join(F.broadcast(plan), "class")  # a row per class
    bin_ = F.element_at("bins", F.size(F.filter("begins", lambda x: x <= rank)))
    placed = materialize(ranked.select("_key", "copies", bin_.alias("shard")), "shard-placed")

    # groups with a large share of the rows are few, whatever the size of the table; their rows stay where they are
    rows = light.count()
    hot = placed.where(F.col("copies") * 2000 > rows).select("_key", F.col("shard").alias("_hot"))
    found = light.join(F.broadcast(hot), "_key", "left")
    cold = found.where("_hot is null").drop("_hot").join(placed.select("_key", "shard"), "_key")
    whole = cold.unionByName(found.where("_hot is not null").withColumnRenamed("_hot", "shard"))
    runs_each = max(1, min(4096, -(-rows // (shards * RUN_ROWS)) * 4))
    spread = materialize(whole.withColumn("_run", F.pmod(F.xxhash64("doc_id", "_key"), F.lit(runs_each)).cast("int")), "shard-spread")
    each = spread.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("n"))
    first = each.withColumn("_first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = spread.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_run").orderBy("doc_id", "_key")) - 1)
    out = numbered.join(F.broadcast(first.drop("n")), ["shard", "_run"])  # at most shards * 4096 rows
    return out.select(
        *back[:-1], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_r") + F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def fixed_capacity(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item where bins have a fixed capacity: best fit in decreasing order, as few bins as it can."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    runs = best_fit([(sizes[i], 1) for i in order], capacity)
    out = [0] * len(sizes)
    for place, bin_, _ in runs:
        out[order[place]] = bin_
    return out

