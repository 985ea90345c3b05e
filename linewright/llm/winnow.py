"""Benchmark decontamination by winnowing.

Both sides are cut into words; every run of K words has a hash, and the least hash of each W consecutive runs is kept
with its place (the rightmost of equals). Two texts that share W + K - 1 words keep the same hash at the same place in
them, so joining on the hash finds every shared span of that length: each hit is extended over the windows of `span`
words that the kept run lies in, and windows that occur in an item add up to spans. A text that repeats itself costs no
more than any other, as each window is looked up once. Benchmark items shorter than a window are one window each, found
through all runs of the document, not only the kept ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm._common import aside, bench_words, released, slices
from linewright.plans.lineage import ship_package

SPAN, RUN = 10, 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of document text in a slice; words of the benchmark in a block, each block broadcast by itself.
SLICE_BYTES, BLOCK_WORDS = 1 << 20, 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = _mix(ids.astype(np.uint64) + np.uint64(1))
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + words[i : i + n]
    return _mix(out)


def kept_places(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost least hash in each w consecutive ones."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, w):
        less = hashes[i : i + n] <= best
        best[less] = hashes[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at)


class Windows:
    """Distinct windows of one length: their hashes in order, a place of each in the items' words, and the items of each."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, places, items = hashes[order], places[order], items[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])])
        hashes, places, self.items = hashes[new], places[new], items[new]
        self.first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        self.hashes, self.places = hashes[self.first], places[self.first]
        self.counts = np.diff(np.append(self.first, len(hashes)))

    def occurring(self, found: np.ndarray, at: np.ndarray, length: int, ids: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places in ids with the hashes of their windows, those that hold one of these windows, word by word; and which."""
        which = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        on = self.hashes[which] == found
        at, which = at[on], which[on]
        same = np.ones(len(at), bool)
        for i in range(length):
            same &= ids[at + i] == words[self.places[which] + i]
        return at[same], which[same]


class Fingerprints:
    """The fingerprints and windows of a block of benchmark items, ready to be sent to executors."""

    def __init__(self, items: list[tuple[object, str | None]], span: int = SPAN, k: int = RUN):
        self.span, self.k = span, k
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[object] = []
        by_length: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        words: list[np.ndarray] = []
        size = 0
        for name, text in items:
            found = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in bench_words(text)], np.int64)
            if len(found):
                by_length.setdefault(min(span, len(found)), []).append((size, found, len(self.names)))
                self.names.append(name)
                words.append(found)
                size += len(found)
        self.words = np.concatenate([np.zeros(0, np.int64), *words])
        self.windows: dict[int, Windows] = {}
        for n, those in by_length.items():
            hashes = [run_hashes(w, n) for _, w, _ in those]
            places = [at + np.arange(len(h)) for (at, _, _), h in zip(those, hashes, strict=True)]
            items_ = [np.full(len(h), i) for (_, _, i), h in zip(those, hashes, strict=True)]
            self.windows[n] = Windows(*(np.concatenate(x) for x in (hashes, places, items_)))
        kept = [(h := run_hashes(w, k))[kept_places(h, span - k + 1)] for _, w, _ in by_length.get(span, ())]
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *kept]))


def hits(prints: Fingerprints, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By length of windows: the places in ids at which a window of an item occurs, and which; 0 separates documents, -1 is an unknown word."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for n, windows in prints.windows.items():
        if n < prints.span:
            h = run_hashes(ids, n)
            out.append((n, *windows.occurring(h, np.arange(len(h)), n, ids, prints.words)))
            continue
        h = run_hashes(ids, prints.k)
        at = kept_places(h, n - prints.k + 1)
        at = at[np.isin(h[at], prints.hashes)]
        starts = np.unique(at[:, None] - np.arange(n - prints.k + 1))
        starts = starts[(starts >= 0) & (starts <= len(ids) - n)]
        if len(starts):
            whole = np.zeros(len(starts), np.uint64)
            for i in range(n):
                whole = whole * _MULTIPLIER + _mix(ids[starts + i].astype(np.uint64) + np.uint64(1))
            out.append((n, *windows.occurring(_mix(whole), starts, n, ids, prints.words)))
    return out


def _mapper(sent, text: str, keep: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: Fingerprints = sent.value
        get = prints.vocabulary.get
        for part in slices(batches, text, SLICE_BYTES):
            ids: list[int] = []
            starts, counts = [], []
            for t in part.column(text).to_pylist():
                found = [get(w, -1) for w in bench_words(t)]
                starts.append(len(ids))
                counts.append(len(found))
                ids += found
                ids.append(0)
            edges = np.array(starts)
            change = np.zeros(len(ids) + 1, np.int64)
            items: list[set[str]] = [set() for _ in starts]
            for n, at, which in hits(prints, np.array(ids, np.int64)):
                np.add.at(change, at, 1)
                np.add.at(change, at + n, -1)
                windows = prints.windows[n]
                doc = np.searchsorted(edges, at, "right") - 1
                for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                    first = windows.first[w]
                    items[d].update(str(prints.names[i]) for i in windows.items[first : first + windows.counts[w]].tolist())
            covered = np.concatenate([[False], np.cumsum(change) > 0])
            turns = np.flatnonzero(covered[1:] != covered[:-1])
            spans: list[list[list[int]]] = [[] for _ in starts]
            for a, b in turns.reshape(-1, 2).tolist():
                d = int(np.searchsorted(edges, a, "right")) - 1
                spans[d].append([a - starts[d], b - starts[d]])
            columns = [part.column(c) for c in keep]
            columns.append(pa.array(counts, pa.int64()))
            columns.append(pa.array(spans, pa.list_(pa.list_(pa.int64()))))
            columns.append(pa.array([sorted(x) for x in items], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of docs, n_words, hit_spans array<array<long>> (word offsets) and items array<string>.

    The benchmark is dealt into blocks of about `block_words` words. One block (the usual case) is one pass over the
    documents; more blocks are one pass each, whose results are put together by row, so that what is broadcast never
    grows beyond a block. Null texts and items have no words; items without an id count under the name 'null'; a
    document that repeats is judged row by row. Columns of docs that clash with those added are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    added = T.StructType().add("n_words", "long").add("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))).add("items", T.ArrayType(T.StringType()))
    keep = [c for c in docs.columns if c not in added.fieldNames()]
    source = docs.select(*keep)
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    words = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 2
    blocks = int(words // block_words) + 1
    from pyspark.sql.pandas.types import to_arrow_schema

    def scan(rows: list, frame: DataFrame, kind: T.StructType, columns: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Fingerprints([(r["item_id"] if r["item_id"] is not None else "null", r["text"]) for r in rows], span, k))
        return frame.mapInArrow(released(_mapper(sent, "text", columns, to_arrow_schema(kind))), kind)

    if blocks == 1:
        return scan(benchmark.select("item_id", "text").collect(), source, schema, keep)
    from linewright.plans.lineage import materialize

    row = next(r for i in range(len(keep) + 1) if (r := f"row_{i}") not in {c.lower() for c in keep})
    keyed = materialize(source.withColumn(row, F.monotonically_increasing_id()), "winnow-rows")
    narrow = T.StructType([T.StructField(row, T.LongType())] + added.fields)
    parts = None
    for b in range(blocks):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = scan(rows, keyed.select(row, "text"), narrow, [row])
        parts = part if parts is None else parts.unionByName(part)
    whole = parts.groupBy(row).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return keyed.join(whole, row).drop(row)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate(
        F.array_sort("hit_spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x[1] - F.greatest(s["end"], x[0]))).alias("n"),
            F.greatest(s["end"], x[1]).alias("end"),
        ),
    )["n"]
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    own, back = aside(docs, ("n_words", "hit_spans", "items"))
    return find_contamination(own, benchmark).where(F.size("hit_spans") == 0).select(*back)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
