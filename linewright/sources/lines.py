"""Scans that turn files and tables into line frames (log_id, line_id from 0, line_num, text)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.functions.text import fold_non_ascii


def split_lines(df: DataFrame, log_id: str, text: str) -> DataFrame:
    """Lines of whole texts, in order; a null text has none."""
    at = F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_id", "text")
    return df.where(F.col(text).isNotNull()).select(F.col(log_id).alias("log_id"), at).select("log_id", F.col("line_id").cast("long").alias("line_id"), F.col("line_id").cast("long").alias("line_num"), "text")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of raw text files, keyed by file and numbered from 0. An empty file has none.

    A file is read in blocks by many tasks. Lines are numbered within their block, and from the counts of the blocks
    before it; only these counts are gathered by file.
    """
    block = [F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path, lineSep="\n").select(*block, F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    counts = rows.groupBy("log_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("log_id", "block", F.coalesce(before, F.lit(0)).alias("start"))
    within = rows.withColumn("place", F.row_number().over(Window.partitionBy("log_id", "block").orderBy("at")) - 1)
    number = (F.col("start") + F.col("place")).cast("long")
    return within.join(starts, ["log_id", "block"]).select("log_id", number.alias("line_id"), number.alias("line_num"), "text")


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON object of size -> [name, [records]], in the numeric order of the keys."""
    record = "array<struct<event_id:string,text:string,line_num:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    each = raw.select(F.explode("m").alias("key", "v")).select(F.col("key").cast("long").alias("size"), F.col("v")[0].alias("log_id"), F.from_json(F.col("v")[1], record).alias("r"))
    rows = each.select("size", "log_id", F.posexplode("r").alias("line_id", "r"))
    return rows.select("size", "log_id", F.col("line_id").cast("long").alias("line_id"), F.col("r.line_num").cast("long").alias("line_num"), "r.event_id", "r.text").orderBy("size", "line_id")


def read_line_table(spark: SparkSession, path: str) -> DataFrame:
    """Columnar JSON of event_id, build_log, text, line_num and group_id."""
    return spark.read.schema("event_id string, build_log string, text string, line_num string, group_id string").json(path).withColumn("line_num", F.col("line_num").cast("long"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=True, schema="EventId string, EventTemplate string, Occurrences long")


def read_event_index(spark: SparkSession, path: str) -> DataFrame:
    """file and event_id from a JSON map of file to events."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("file", "events")).select("file", F.posexplode("events").alias("place", "event_id"))


def select_events(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose event_id is listed."""
    return records.join(wanted.select("event_id").distinct(), "event_id", "left_semi")


def read_template_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """id, template and triples of a JSON object of id -> [template, [[subject, verb, object], …]]."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("id", "v"))
    return raw.select("id", F.col("v")[0].alias("template"), F.from_json(F.col("v")[1], "array<array<string>>").alias("triples"))


def decode_list(column):
    """A printed list of quoted strings as an array; quotes of either kind, no escapes inside."""
    return F.transform(F.regexp_extract_all(column, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def compile_format(fmt: str) -> tuple[str, list[str]]:
    """A pattern with one lazy group for each <Header> of a log format, and the headers. Runs of spaces match any."""
    headers = re.findall(r"<([^<>]+)>", fmt)
    literal = [re.sub(" +", lambda _: r"\s+", re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", part)) for part in re.split(r"<[^<>]+>", fmt)]
    body = literal[0] + "".join(f"(.*?){part}" for part in literal[1:])
    return f"^{body}$", headers


def read_structured(lines: DataFrame, fmt: str = "<Content>", order: tuple[str, ...] = ("log_id", "line_id"), ascii_only: bool = False) -> DataFrame:
    """LineId (from 1, dense over the lines that match, in each log) and a column for each header of the format."""
    pattern, headers = compile_format(fmt)
    text = fold_non_ascii(F.col("text")) if ascii_only else F.col("text")
    kept = lines.withColumn("_t", F.trim(text)).where(F.col("_t").rlike(pattern))
    number = F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])).cast("long")
    return kept.select(order[0], number.alias("LineId"), *[F.regexp_extract("_t", pattern, i + 1).alias(h) for i, h in enumerate(headers)])


def read_annotated(lines: DataFrame) -> DataFrame:
    """Lines of blocks with the block's summary.

    A block begins with `#n#`, then come its lines, an empty line, `#summary:#` and a line of summary. A summary mark that
    isn't behind an empty line is a line like any other.
    """
    w = Window.partitionBy("log_id").orderBy("line_id")
    head = F.col("text").rlike(r"^#\d+#\s*$")
    marked = lines.withColumns({"head": head, "before": F.lag("text").over(w), "mark": F.col("text").rlike(r"^#summary:#\s*$")})
    marked = marked.withColumn("mark", F.col("mark") & (F.trim(F.coalesce("before", F.lit(""))) == ""))
    marked = marked.withColumn("block", F.sum(F.col("head").cast("int")).over(w)).withColumn("is_summary", F.coalesce(F.lag("mark").over(w), F.lit(False)))
    body = marked.where((F.col("block") > 0) & ~F.col("head") & ~F.col("mark") & (F.trim("text") != ""))
    summaries = body.where("is_summary").groupBy("log_id", "block").agg(F.min_by("text", "line_id").alias("summary"))
    return body.where("not is_summary").join(summaries, ["log_id", "block"], "left").select("log_id", F.col("block").cast("long").alias("block"), "line_id", "text", "summary")


def split_alternatives(lines: DataFrame) -> DataFrame:
    """Alternatives of each line, which are separated and may be ended by `;`."""
    each = lines.select("log_id", "line_id", F.posexplode(F.split("text", ";")).alias("alternative", "value"))
    return each.select("log_id", "line_id", F.col("alternative").cast("long").alias("alternative"), F.trim("value").alias("summary")).where("summary <> ''")


def read_structured_table(spark: SparkSession, path: str, headers: tuple[str, ...] = ("Content",)) -> DataFrame:
    """A table of structured lines as the sink writes it: LineId, the headers of its format, EventId, EventTemplate and ParameterList (an array again)."""
    kind = ", ".join(["LineId long", *[f"`{h}` string" for h in headers], "EventId string", "EventTemplate string", "ParameterList string"])
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True, schema=kind)
    listed = F.when(F.col("ParameterList").startswith('["'), F.from_json("ParameterList", "array<string>")).otherwise(decode_list(F.col("ParameterList")))
    return raw.withColumn("ParameterList", listed)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A distance matrix that was written as a table of pairs: log_id, i, j and d."""
    return spark.read.parquet(path).select("log_id", "i", "j", "d")


def load_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at a path, or what compute() gives, written there first. A table that wasn't written to its end is made anew."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_hdf5(spark: SparkSession, path: str, attributes: tuple[str, ...], ids: DataFrame | None = None) -> DataFrame:
    """file, id and the attributes (as strings) of the top groups of HDF5 files, of the listed ids (column id) only, if given.

    Files reach the tasks as bytes, so any store will do. Needs the format's library on the executors.
    """
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py") from e
    import pandas as pd

    def read(batches):
        import io

        import h5py

        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with h5py.File(io.BytesIO(content), "r") as f:
                    rows += [(file, name, *[None if a not in group.attrs else str(group.attrs[a]) for a in attributes]) for name, group in f.items()]
            yield pd.DataFrame(rows, columns=["file", "id", *attributes])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, ", ".join(f"`{c}` string" for c in ("file", "id", *attributes)))
    return found if ids is None else found.join(ids.select("id").distinct(), "id", "left_semi")
