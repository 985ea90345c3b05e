"""Byte-level BPE encoding and decoding over length-bucketed, padded numpy matrices.

Texts are cut by the tokenizer's pattern. The distinct pieces of a slice of rows are put into one matrix per length
bucket; each round finds every row's leftmost pair of least rank by a hashed pair lookup, merges it and compacts the
row, until no row has a pair in the vocabulary. Null and empty texts have no ids. Rows are independent: ties, repeated
rows and long texts need no special care, and extra columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from linewright.llm._common import released, slices
from linewright.plans.lineage import ship_package

NO_RANK = np.int32(2**31 - 1)
PAD = np.int32(-1)
#: Rows of a matrix, and the longest piece that goes into one; a longer piece is merged with a heap, in n log n.
MATRIX_CELLS, LONGEST_ROW = 1 << 17, 256
#: Bytes of text in a slice, and pieces kept from slice to slice.
SLICE_BYTES, KEPT_PIECES = 1 << 20, 100_000


class PairRanks:
    """Open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(4, (len(pairs) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        self.probes = 1
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        slots = self._home(keys)
        for key, slot, rank in zip(keys.tolist(), slots.tolist(), pairs.values(), strict=True):
            n = 1
            while self.keys[slot] != -1:
                slot, n = (slot + 1) & self.mask, n + 1
            self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, n)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key; NO_RANK where there is none (negative keys never have one)."""
        slots = self._home(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NO_RANK)
        left = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        at = slots[left]
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at = (at + 1) & self.mask
            want, found = keys[left], self.keys[at]
            hit = found == want
            out[left[hit]] = self.ranks[at[hit]]
            on = ~hit & (found != -1)
            left, at = left[on], at[on]
        out[keys < 0] = NO_RANK
        return out


class Vocabulary:
    """Ranks of a tiktoken file, and every pair of them whose bytes together have a rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.table = PairRanks(self.pairs)
        self.pattern = regex.compile(pattern)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def merge_matrix(vocab: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge each row of a padded matrix to the end: one pair a row and round. Returns the matrix and lengths."""
    done = ids.copy()
    done_lengths = lengths.copy()
    rows = np.arange(len(ids))
    keys = ids[:, :-1].astype(np.int64) << 32 | ids[:, 1:].astype(np.int64)
    keys[(ids[:, :-1] < 0) | (ids[:, 1:] < 0)] = -1
    ranks = vocab.table.look_up(keys.ravel()).reshape(keys.shape)
    while True:
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ranks), np.int64)
        best = ranks[np.arange(len(ranks)), at] if ranks.shape[1] else np.full(len(ranks), NO_RANK)
        live = best != NO_RANK
        if not live.all():
            over = ~live
            done[rows[over], : ids.shape[1]] = ids[over]
            done[rows[over], ids.shape[1] :] = PAD
            done_lengths[rows[over]] = lengths[over]
            rows, ids, ranks, lengths, at, best = rows[live], ids[live], ranks[live], lengths[live], at[live], best[live]
            if not len(rows):
                return done, done_lengths
        n, width = ids.shape
        r = np.arange(n)
        # compaction: column j takes column j + 1 right of the merged pair
        source = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > at[:, None])
        ids = np.take_along_axis(ids, source, axis=1)
        ids[r, at] = best
        lengths = lengths - 1
        width -= 1
        if width < 2:
            ranks = np.full((n, 0), NO_RANK, np.int32)
            continue
        columns = np.arange(width - 1)[None, :]
        ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
        for side in (-1, 0):  # the pairs left and right of the new id
            j = at + side
            ok = (j >= 0) & (j < width - 1)
            a, b = ids[r[ok], j[ok]].astype(np.int64), ids[r[ok], j[ok] + 1].astype(np.int64)
            ranks[r[ok], j[ok]] = vocab.table.look_up(np.where((a < 0) | (b < 0), -1, a << 32 | b))
        longest = int(lengths.max())
        if longest < width:
            ids, ranks = ids[:, :longest], ranks[:, : max(0, longest - 1)]


def merge_long(vocab: Vocabulary, piece: bytes) -> np.ndarray:
    """The same merges for one long piece: a heap of (rank, place) over a linked list."""
    ids = vocab.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = vocab.pairs
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := pairs.get(rank << 32 | ids[after[i]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := pairs.get(ids[before[i]] << 32 | rank)) is not None:
            heapq.heappush(heap, (r, before[i]))
    return np.array([x for x in ids if x >= 0], np.int32)


def encode_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """The ids of each piece as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if (rank := vocab.ranks.get(piece)) is not None:  # a piece that is a token needs no merges
            out[i] = rank.to_bytes(4, "little")
        elif len(piece) > LONGEST_ROW:
            out[i] = merge_long(vocab, piece).astype("<u4").tobytes()
        else:
            buckets.setdefault(max(2, len(piece) if len(piece) <= 12 else -(-len(piece) // 8) * 8), []).append(i)
    for width, members in buckets.items():
        step = max(1, MATRIX_CELLS // width)
        for start in range(0, len(members), step):
            part = members[start : start + step]
            lengths = np.array([len(pieces[i]) for i in part])
            raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
            ids = np.where(np.arange(width) < lengths[:, None], vocab.byte_ids[raw], PAD)
            merged, lengths = merge_matrix(vocab, ids, lengths)
            flat = merged.astype("<u4").tobytes()
            for row, (i, n) in enumerate(zip(part, lengths.tolist(), strict=True)):
                out[i] = flat[row * width * 4 : row * width * 4 + n * 4]
    return out


def encode_texts(vocab: Vocabulary, texts: list[str | None], kept: dict[str, bytes]) -> list[bytes]:
    """Ids of each text; kept holds ids of pieces from earlier slices and is emptied when it is full."""
    split = [vocab.pattern.findall(t) if t else [] for t in texts]
    if len(kept) > KEPT_PIECES:
        kept.clear()
    new = list({p for pieces in split for p in pieces if p not in kept})
    kept.update(zip(new, encode_pieces(vocab, [p.encode() for p in new]), strict=True))
    return [b"".join([kept[p] for p in pieces]) for pieces in split]


def decode_ids(vocab: Vocabulary, ids: bytes) -> bytes:
    return b"".join(map(vocab.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapper(path: str, pattern: str, text: str, keep: list[str], schema: pa.Schema, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, kept = vocabulary(path, pattern), {}
        for part in slices(batches, text, SLICE_BYTES):
            ids = encode_texts(vocab, part.column(text).to_pylist(), kept)
            columns = [part.column(c) for c in keep]
            columns.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
            if digests:
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                columns.append(pa.array([hashlib.sha256(decode_ids(vocab, x)).hexdigest() for x in ids]))
            else:
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _run(spark: SparkSession, docs: DataFrame, path: str, pattern: str, text: str, added: T.StructType, digests: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(spark)
    keep = [c for c in docs.columns if c != text and c not in added.fieldNames()]
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    return docs.select(*keep, text).mapInArrow(released(_mapper(path, pattern, text, keep, to_arrow_schema(schema), digests)), schema)


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns but the text (and any that clash with those added), n_tokens and ids array<int>."""
    added = T.StructType().add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType(), False))
    return _run(docs.sparkSession, docs, path, pattern, text, added, False)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of an ids column; bytes that aren't UTF-8 on their own become U+FFFD. A null list gives null."""
    from pyspark.sql import functions as F

    ship_package(encoded.sparkSession)

    @F.pandas_udf(T.StringType())
    def decode(column):
        vocab = vocabulary(path, pattern)
        return column.map(lambda x: None if x is None else decode_ids(vocab, np.asarray(x, "<u4").tobytes()).decode("utf-8", "replace"))

    return encoded.withColumn(text, decode(ids))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: the digests of the ids and of the bytes that they decode to."""
    added = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _run(docs.sparkSession, docs.select("doc_id", text), path, pattern, text, added, True)
