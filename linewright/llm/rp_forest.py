"""Approximate nearest neighbours in a forest of random-projection trees.

Each level of each tree projects on its own random direction and splits a node at the median of a bounded sample's
projections. Every vector is put into its leaf of every tree. A query walks all trees with one priority queue: the node
whose worst margin so far is best comes next, until the leaves reached hold a fixed share of all vectors. Leaves meet
the queries that reached them, and cosines are computed exactly there; a leaf returns a query's best few, never a pair
for each of its vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.plans.lineage import materialize, ship_package

#: Trees and levels; the share of all vectors that a query's leaves hold together (a vector counts once for each tree).
TREES, DEPTH, SHARE = 16, 8, 0.8
#: With fewer vectors in its leaves than this, a query goes on.
LEAST = 4000
#: Vectors that the medians are taken of, at most (about); vectors, and queries, of a leaf in a block.
SAMPLE, BLOCK = 20_000, 4096
#: Candidates beyond the k that a block returns, so that scores equal but for their last bits all come along.
SPARE = 3


@dataclass
class Forest:
    directions: np.ndarray  # trees, dimensions, levels
    medians: list[list[np.ndarray]] = field(default_factory=list)  # by tree and level, one for each node
    sizes: np.ndarray | None = None  # by tree and leaf

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        made = cls(rng.normal(size=(trees, sample.shape[1], depth)))
        made.directions /= np.linalg.norm(made.directions, axis=1, keepdims=True)
        for t in range(trees):
            projected, node, levels = sample @ made.directions[t], np.zeros(len(sample), np.int64), []
            for d in range(depth):
                order = np.argsort(node, kind="stable")
                cut = np.searchsorted(node[order], np.arange((1 << d) + 1))
                medians = np.array([np.median(projected[order[a:b], d]) if b > a else 0.0 for a, b in zip(cut[:-1], cut[1:], strict=True)])
                levels.append(medians)
                node = node * 2 + (projected[:, d] > medians[node])
            made.medians.append(levels)
        return made

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector (rows) in each tree (columns)."""
        out = np.zeros((len(vectors), len(self.directions)), np.int32)
        for t, direction in enumerate(self.directions):
            projected, node = vectors @ direction, np.zeros(len(vectors), np.int64)
            for d, medians in enumerate(self.medians[t]):
                node = node * 2 + (projected[:, d] > medians[node])
            out[:, t] = node
        return out

    def search(self, vector: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold enough vectors."""
        projected = np.einsum("tdl,d->tl", self.directions, vector)
        queue = [(-np.inf, t, 0, 0) for t in range(len(self.directions))]
        out, held = [], 0
        while queue and held < enough:
            worst, t, d, node = heapq.heappop(queue)
            if d == len(self.medians[t]):
                if self.sizes[t, node]:
                    out.append((t, node))
                    held += int(self.sizes[t, node])
                continue
            margin = float(projected[t, d] - self.medians[t][d][node])
            # the queue holds the negated least margin on the way; the side not taken has a negative one
            heapq.heappush(queue, (max(worst, -margin), t, d + 1, node * 2 + 1))
            heapq.heappush(queue, (max(worst, margin), t, d + 1, node * 2))
        return out


def usable(vector: str) -> Column:
    """Vectors without null or non-finite components that aren't zero."""
    v = F.col(vector)
    limit = F.lit(float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(v, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _arrow_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _place(sent, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = sent.value.leaves(_unit(_arrow_matrix(batch.column("vector"))))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), leaves.shape[1]).cast(schema.field("leaves").type)
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("vector").cast(schema.field("vector").type), flat], schema=schema)

    return run


def _walk(sent, enough: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                found = sent.value.search(_unit(_arrow_matrix(one.column("vector")))[0], enough)
                at = pa.array(np.zeros(len(found), np.int32))
                yield pa.RecordBatch.from_arrays([
                    one.column("query").take(at), one.column("vector").take(at).cast(schema.field("vector").type),
                    pa.array([t for t, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32()),
                ], schema=schema)

    return run


def _meet(best: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """The best classes of one block of a leaf for each query that reached it."""
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query": [], "class": [], "score": []}).astype({"query": "int64", "class": "int64", "score": "float64"})
        vectors = vectors.sort_values("class")
        ids, q, v = vectors["class"].to_numpy(), _matrix(queries["vector"]), _matrix(vectors["vector"])
        q, v = _unit(q), _unit(v)
        k = min(best, len(ids))
        top = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :k].ravel()
        rows = np.repeat(np.arange(len(q)), k)
        # products of whole blocks may differ in their last bits with the block's shape: each score is summed in one order
        return pd.DataFrame({"query": queries["query"].to_numpy()[rows], "class": ids[top], "score": (q[rows] * v[top]).sum(axis=1)})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, trees: int = TREES, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row of vectors(vec_id, embedding) that queries holds for.

    Vectors that are null, zero or not finite, or have another length than the commonest, and rows without a vec_id take
    no part. Equal vectors are one class in the index, with its k + 1 least ids, which are all that a query can need.
    Ties go to the smaller vec_id. A row is no neighbour of its own vec_id. An empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = vectors.sparkSession
    ship_package(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    length = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").first()
    if length is None:
        return spark.createDataFrame([], empty)
    rows = materialize(rows.where(F.size("vector") == length["length"]), "vectors")
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = few.groupBy("vector").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = materialize(classes, "vector-classes")
    n = classes.count()

    rate = min(1.0, SAMPLE / n)
    sample = classes.where(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < rate * 1_000_000).select("class", "vector").toArrow()  # about SAMPLE rows
    matrix = _arrow_matrix(sample.column("vector").combine_chunks()) if len(sample) else np.zeros((0, length["length"]))
    forest = Forest.fit(_unit(matrix) if len(matrix) else matrix, trees, depth)
    placed_type = T.StructType().add("class", "long").add("vector", T.ArrayType(T.DoubleType())).add("leaves", T.ArrayType(T.IntegerType()))
    sent = spark.sparkContext.broadcast(forest)
    placed = materialize(classes.select("class", "vector").mapInArrow(_place(sent, to_arrow_schema(placed_type)), placed_type), "leaves")
    index = placed.select("class", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    counted = placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # trees * 2 ** depth rows
    forest.sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in counted:
        forest.sizes[r["tree"], r["leaf"]] = r["n"]

    asked = materialize(rows.where(queries).select(F.col("vec_id").alias("query"), "vector"), "queries")
    walk_type = T.StructType().add("query", "long").add("vector", T.ArrayType(T.DoubleType())).add("tree", "integer").add("leaf", "integer")
    sized = spark.sparkContext.broadcast(forest)
    reached = materialize(asked.mapInArrow(_walk(sized, max(share * n, LEAST), to_arrow_schema(walk_type)), walk_type), "walks")

    blocks = int(-(-int(forest.sizes.max()) // BLOCK))
    most = reached.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = reached.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    right = index.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    keys = ["tree", "leaf", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meet(k + SPARE), "query long, class long, score double")
    found = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    close = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("r") <= k + 1)
    close = materialize(close.drop("r"), "close")
    each = close.join(classes.select("class", F.explode("members").alias("vec_id")), "class").where("vec_id <> query")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", F.least("score", F.lit(1.0)).alias("score"))
