"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Translates ASCII separators of benchmark words to spaces and A-Z to a-z; bytes from 0x80 stay, as word characters.
_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
BENCH_TABLE = bytes(
    b if b >= 0x80 or b in _ALNUM else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def bench_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").translate(BENCH_TABLE).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold that held-out rows are told by. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that the named text column has about most_bytes a slice."""
    for batch in batches:
        start = size = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a mapper of batches, that gives the memory of its batches back to the system when its task ends: a worker that waits for its next task holds none."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with those of its columns renamed whose names an operator uses itself, and the expressions that give all columns back under their own names."""
    taken = {c.lower() for c in (*docs.columns, *used)}
    names, n = {}, 0
    for c in docs.columns:
        names[c] = c
        if c.lower() in {u.lower() for u in used}:
            while f"own_{n}" in taken:
                n += 1
            names[c] = f"own_{n}"
            taken.add(names[c])
    return docs.toDF(*names.values()), [F.col(f"`{new}`").alias(old) for old, new in names.items()]


#: Values that earlier() folds in one go.
FOLDED = 64


def earlier(values: Column, add: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Of an array<int>, at each place what add makes of all values before it, beginning at zero.

    Block by block, as appending to an array copies it: the cost is nearly in proportion to the values.
    """
    none = F.array().cast("array<int>")

    def fold(xs: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / FOLDED).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * FOLDED + 1, F.lit(FOLDED)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), lambda a, x: add(a, x)))
    zipped = F.arrays_zip(blocks.alias("b"), fold(totals, F.lit(zero)).alias("s"))
    return F.flatten(F.transform(zipped, lambda z: fold(z["b"], z["s"])))


def matches(docs: DataFrame, text: Column, patterns: dict[str, tuple[str, Column]], left: int, right: int) -> DataFrame:
    """docs with a column for each pattern: every match's s, e (code points, end exclusive), v, l and r (neighbours of up to so many characters), leftmost and non-overlapping.

    patterns: column, pattern and whether a text is worth a scan. The cost is in proportion to the text, however many matches it has.
    """
    zipped = {}
    for name, (pattern, worth) in patterns.items():
        pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped[name] = F.when(worth, F.arrays_zip(pieces.alias("p"), found.alias("m")))
    docs = docs.select("*", *[x.alias(name) for name, x in zipped.items()])
    length = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def spans(name: str) -> Column:
        z = F.col(name)
        at = earlier(F.transform(z, length), lambda a, x: a + x)
        after = F.slice(F.transform(z, lambda x: F.substring(x["p"], 1, right)), F.lit(2), F.size(z))
        all_ = F.arrays_zip(z.alias("z"), at.alias("at"), after.alias("r"))

        def one(x: Column) -> Column:
            s = x["at"] + F.length(x["z"]["p"])
            return F.struct(s.alias("s"), (s + F.length(x["z"]["m"])).alias("e"), x["z"]["m"].alias("v"), F.right(x["z"]["p"], F.lit(left)).alias("l"), x["r"].alias("r"))

        return F.when(z.isNull(), F.array().cast(SPANS)).otherwise(F.transform(F.filter(all_, lambda x: x["z"]["m"].isNotNull()), one).cast(SPANS))

    return docs.withColumns({name: spans(name) for name in patterns})


SPANS = "array<struct<s:int,e:int,v:string,l:string,r:string>>"
