import json

from pyspark.sql import functions as F

from linewright.sources import lines, sinks
from linewright.streaming.windows import counts_by_window


def test_text_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n\nlast\n")
    (tmp_path / "b.log").write_text("")
    got = [(r["log_id"].rsplit("/", 1)[1], r["line_id"], r["text"]) for r in lines.read_text(spark, str(tmp_path)).orderBy("log_id", "line_id").collect()]
    assert got == [("a.log", 0, "one"), ("a.log", 1, "two"), ("a.log", 2, ""), ("a.log", 3, "last")]


def test_json_scans(spark, tmp_path):
    record = lambda i: {"event_id": f"e{i}", "text": f"t{i}", "line_num": str(10 * i)}
    p = tmp_path / "logs.json"
    p.write_text(json.dumps({"10": ["big", [record(1), record(2)]], "9": ["small", [record(3)]]}))
    rows = lines.read_json_logs(spark, str(p)).collect()
    assert [(r["size"], r["log_id"], r["line_num"], r["event_id"]) for r in rows] == [(9, "small", 30, "e3"), (10, "big", 10, "e1"), (10, "big", 20, "e2")]
    t = tmp_path / "templates.json"
    t.write_text(json.dumps({"x1": ["open * of VAR1", [["a", "b", "c"], ["d", "e", "f"]]]}))
    one = lines.read_template_dictionary(spark, str(t)).first()
    assert one["id"] == "x1" and one["triples"] == [["a", "b", "c"], ["d", "e", "f"]]
    i = tmp_path / "index.json"
    i.write_text(json.dumps({"f": ["e1", "e3"]}))
    index = lines.read_event_index(spark, str(i))
    assert {r["event_id"] for r in lines.select_events(lines.read_json_logs(spark, str(p)), index).collect()} == {"e1", "e3"}


def test_formats(spark):
    pattern, headers = lines.compile_format("<Date> [<Level>]  <Content>")
    assert headers == ["Date", "Level", "Content"] and pattern == r"^(.*?)\s+\[(.*?)\]\s+(.*?)$"
    d = spark.createDataFrame([("a", 0, "d1 [INFO]   hello é"), ("a", 1, "junk"), ("a", 2, "d2 [WARN] x")], "log_id string, line_id long, text string")
    got = lines.read_structured(d, "<Date> [<Level>] <Content>", ascii_only=True).orderBy("LineId").collect()
    assert [(r["LineId"], r["Level"], r["Content"]) for r in got] == [(1, "INFO", "hello <NASCII>"), (2, "WARN", "x")]


def test_annotated_and_lists(spark):
    text = ["#1#", "l1", "l2", "", "#summary:#", "s1", "", "#2#", "l3", "#summary:#", "s2", ""]
    d = spark.createDataFrame([("a", i, t) for i, t in enumerate(text)], "log_id string, line_id long, text string")
    got = [(r["block"], r["text"], r["summary"]) for r in lines.read_annotated(d).orderBy("line_id").collect()]
    assert got == [(1, "l1", "s1"), (1, "l2", "s1"), (2, "l3", None), (2, "#summary:#", None), (2, "s2", None)]
    one = spark.createDataFrame([("['a', \"b c\", 'd']",), ("[]",)], "x string").select(lines.decode_list(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in one] == [["a", "b c", "d"], []]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a,\"b", ["x", "y"])], "LineId long, Content string, ParameterList array<string>")
    sinks.write_structured(d, str(tmp_path / "s"))
    back = spark.read.csv(str(tmp_path / "s"), header=True, escape='"').first()
    assert back["Content"] == 'a,"b' and json.loads(back["ParameterList"]) == ["x", "y"]
    t = spark.createDataFrame([("id", "a <*>", 3)], "EventId string, EventTemplate string, Occurrences long")
    sinks.write_templates(t, str(tmp_path / "t"))
    assert lines.read_templates(spark, str(tmp_path / "t")).collect() == t.collect()
    for run in (0, 1):
        sinks.append_run(t, run, str(tmp_path / "r"))
    assert sinks.finished_runs(spark, str(tmp_path / "r")) == {0, 1}
    assert json.loads(sinks.encode_json(d).first()["json"])["ParameterList"] == ["x", "y"]
    assert sinks.one_hot(d, "LineId", "ParameterList").columns == ["LineId", "x", "y"]
    page = sinks.html_page(spark.createDataFrame([(1, "<b>b</b>"), (0, "<i>a</i>")], "line_id long, html string"))
    assert page.index("<i>") < page.index("<b>")


def test_stream_gives_the_same_windows(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")
    q = counts_by_window(stream, "1 hour", "2 hours").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    want = counts_by_window(batch, "1 hour", "2 hours").select("start", "event_type", "n").collect()
    assert sorted(map(tuple, spark.table("windows").select("start", "event_type", "n").collect())) == sorted(map(tuple, want))
