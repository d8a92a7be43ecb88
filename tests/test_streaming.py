"""The watch: bursts, framing, retractions; the stream against the batch."""

import datetime as dt
import json

from pyspark.sql import functions as F

from brindle import render
from brindle.functions import text as T
from brindle.sources import external
from brindle.streaming import watch as W

T0 = dt.datetime(2024, 1, 1)
ROWS = [("src/a.rs", 0), ("src/b.rs", 100), ("target/x.rs", 200), ("src/a.rs", 900), ("Cargo.toml", 1000), ("x.txt", 1100), (".git/y.rs", 1200)]


def events(spark, rows=ROWS):
    return spark.createDataFrame([(p, T0 + dt.timedelta(milliseconds=m)) for p, m in rows], "path string, ts timestamp")


def test_bursts_batch_and_stream(spark, tmp_path):
    want = [(["src/a.rs", "src/b.rs"], 2), (["Cargo.toml", "src/a.rs"], 2)]
    assert [(r["paths"], r["n"]) for r in W.bursts(events(spark)).orderBy("start").collect()] == want
    late = [*ROWS, ("end.rs", 3_600_000)]
    events(spark, late).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in"))
    q = W.bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["paths"], r["n"]) for r in spark.table("bursts").orderBy("start").collect()] == want


def test_watch_frames_batches(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in"))
    W.watch(stream, lambda rows: rows.select("path").distinct(), out.append, str(tmp_path / "c"), once=True).awaitTermination(120)
    lines = [json.loads(x) for batch in out for x in batch]
    assert lines[-1] == {"event": "batch-end", "count": 3} and {x["path"] for x in lines[:-1]} == {"src/a.rs", "src/b.rs", "Cargo.toml"}


def test_retractions_and_diagnostics(spark):
    old, new = (spark.createDataFrame([(f, 1, 0, "warning", "k") for f in fs], "file string, line int, col int, severity string, kind string") for fs in (["a", "b"], ["b", "c"]))
    assert [r["file"] for r in W.retractions(old, new).collect()] == ["a"]
    d = {r["file"]: r["diagnostics"] for r in W.diagnostics(new).collect()}
    assert d["b"][0]["line"] == 0 and d["b"][0]["col"] == 0 and d["b"][0]["severity"] == 2
    ticks = spark.createDataFrame([("w", 1), ("w", 3), ("v", 2)], "workspace string, tick int")
    assert {tuple(r) for r in W.latest(ticks).collect()} == {("w", 3), ("v", 2)}


def test_debounce():
    now = [0.0]
    d = W.Debounce(0.25, lambda: now[0])
    d.event()
    now[0] = 0.2
    assert not d.ready()
    d.event()
    now[0] = 0.4
    assert not d.ready()
    now[0] = 0.46
    assert d.ready() and not d.ready()


def test_external_payloads(spark):
    p = spark.createDataFrame([('[{"file":"a.ts","line":3,"kind":"unused","message":"m"}]',), ('{"findings":[{"path":"b.ts","category":"c","severity":"error"}]}',), ("broken",)], "j string")
    got = {(r["file"], r["line"], r["kind"], r["severity"]) for r in external.finding_lists(p, "j").collect()}
    assert got == {("a.ts", 3, "unused", "warning"), ("b.ts", 0, "c", "error")}
    a = spark.createDataFrame([('{"vulnerabilities":{"list":[{"advisory":{"id":"R1","title":"t","url":"u"},"package":{"name":"n","version":"1"}}]}}',)], "j string")
    assert [tuple(r) for r in external.advisories(a, "j").collect()] == [("R1", "t", "u", "n", "1")]
    assert external.sizes('noise\n{"crates":[{"name":"a","size":300},{"name":"b","size":100}]}') == [("a", 300), ("b", 100)]
    m = spark.createDataFrame([('{"x":{"p":"1"}}',)], "j string")
    assert [tuple(r) for r in external.mapping(m, "j").collect()] == [("x", "p", "1")]


def test_text_functions(spark):
    df = spark.createDataFrame([("a::b::run_x", "/w/src/a/mod.rs", "x  y\n z", "{a} {{b}} {c:?} {0}", " 3 files changed, 10 insertions(+), 2 deletions(-)")], "q string, p string, t string, f string, s string")
    r = df.select(
        T.leaf(F.col("q")).alias("leaf"), T.glob(F.col("q"), "a::*::run_*").alias("g1"), T.glob(F.col("q"), "*run*").alias("g2"), T.glob(F.col("q"), "**run*").alias("g3"), T.module_of(F.col("p"), F.lit("/w/src")).alias("m"), T.collapse(F.col("t")).alias("c"),
        T.format_names(F.col("f")).alias("names"), T.shortstat(F.col("s")).alias("stat"), T.lines(F.col("t"), 2, 2).alias("l"), T.line_count(F.col("t")).alias("n"), T.relative(F.lit("/tmp/z/w/src/a.rs"), "/home/w").alias("rel"), T.drop_visibility(F.lit("  pub(crate) fn x()")).alias("v")).first()
    assert (r["leaf"], r["g1"], r["g2"], r["g3"], r["m"], r["c"], r["names"], tuple(r["stat"]), r["l"], r["n"], r["rel"], r["v"]) == ("run_x", True, False, True, "a", "x y z", ["a", "c"], (3, 10, 2), " z", 2, "src/a.rs", "  fn x()")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert render.dot(e) == 'digraph deps {\n  "a" -> "b";\n}\n'


def test_rewritten_and_removed_files_are_followed(spark, tmp_path):
    import os

    for k, name in enumerate("abc"):
        (tmp_path / f"{name}.rs").write_text("fn x() {}")
        os.utime(tmp_path / f"{name}.rs", (1000 + k, 1000 + k))
    now, out, k = [0.0], [], [0]

    def wait(seconds):
        now[0] += 0.2
        k[0] += 1
        if k[0] == 1:
            os.utime(tmp_path / "a.rs", (2000, 2000))
        if k[0] == 2:
            (tmp_path / "b.rs").unlink()
            (tmp_path / "d.rs").write_text("fn y() {}")

    name = F.substring_index("path", "/", -1).alias("name")
    W.follow(spark, str(tmp_path), lambda c: c.select(name, "change").orderBy("name"), out.append, quiet=0.25, rounds=7, clock=lambda: now[0], wait=wait)
    assert [json.loads(x) for batch in out for x in batch] == [{"name": "a.rs", "change": "changed"}, {"name": "b.rs", "change": "removed"}, {"name": "d.rs", "change": "added"}, {"event": "batch-end", "count": 3}]
