import os

import pytest

from pyspark.sql import functions as F

from pageloom.cli import index_directory
from pageloom.operators import index as I
from pageloom.serve import State, directive, serve
from pageloom.sources.config import ConfigError, expanduser, load
from pageloom.sources.store import IndexStore, IndexVersionError
from pageloom.streaming import batcher

FILES = "id long, path string, mtime double, indexed_at string, lang string"


def test_difference_and_dry_run(spark):
    stored = spark.createDataFrame([(1, "/r/same", 1.0), (2, "/r/changed", 1.0), (3, "/r/gone", 1.0), (4, "/rx/other", 1.0)], "id long, path string, mtime double")
    disk = spark.createDataFrame([("/r/same", 1.0), ("/r/changed", 501.0), ("/r/new", 1.0)], "path string, mtime double")
    assert I.dry_run(disk, stored, "/r").first().asDict() == {"to_process": 2, "new_files": 1, "changed": 1, "skipped": 1, "stale": 1}
    assert {r.state for r in I.difference(disk, stored, full=True).collect()} == {"new", "changed"}
    assert I.dry_run(disk.limit(0), stored.limit(0), "/r").first()["to_process"] == 0


def test_upsert_keeps_ids(spark):
    files = spark.createDataFrame([(1, "/a", 1.0, "t0", None), (2, "/b", 1.0, "t0", "eng")], FILES)
    results = spark.createDataFrame([("/a", 2.0, "text", "x"), ("/b", 2.0, "failed", None), ("/c", 1.0, "empty", None), ("/d", 1.0, "failed", None), ("/c", 1.0, "empty", None)], "path string, mtime double, status string, text string")
    got = {r.path: (r.id, r.mtime, r.indexed_at, r.lang, r.written) for r in I.upsert(files, results, "t1", "deu").collect()}
    assert got == {"/a": (1, 2.0, "t1", "deu", True), "/b": (2, 1.0, "t0", "eng", False), "/c": (3, 1.0, "t1", "deu", True)}


def test_rename_and_delete(spark):
    files = spark.createDataFrame([(1, "/a", 1.0, "t", None), (2, "/b", 1.0, "t", None)], FILES)
    moves = spark.createDataFrame([("/a", "/b"), ("/x", "/y")], "old string, new string")
    assert [(r.id, r.path) for r in I.rename(files, moves).collect()] == [(1, "/b")]
    assert I.delete(files, spark.createDataFrame([("/a",), ("/zz",)], "path string")).count() == 1


def test_watch_plan(spark):
    stored = spark.createDataFrame([("/old.png", 5.0), ("/gone.png", 6.0), ("/mod.png", 1.0)], "path string, mtime double")
    disk = spark.createDataFrame([("/new.png", 5.0), ("/mod.png", 2.0), ("/twin.png", 5.0)], "path string, mtime double")
    touched = spark.createDataFrame([(p,) for p in ("/old.png", "/new.png", "/gone.png", "/mod.png", "/never.png", "/twin.png", "/old.png")], "path string")
    got = sorted((r.action, r.path, r.new_path) for r in I.watch_plan(touched, stored, disk).collect())
    assert got == [("delete", "/gone.png", None), ("index", "/mod.png", None), ("index", "/twin.png", None), ("rename", "/old.png", "/new.png")]


def test_numbering(spark):
    rows = spark.range(99).selectExpr("concat('/', lpad(id, 3, '0')) as path")
    assert I.strided_sample(rows).count() == 33 and I.strided_sample(rows).agg({"path": "max"}).first()[0] == "/096"
    assert sorted(r["count"] for r in I.batches(rows).groupBy("batch").count().collect()) == [3] + [16] * 6
    assert I.batches(rows.limit(0)).count() == 0


def test_batches(spark):
    ev = spark.createDataFrame([("r", float(t), "x") for t in (0, 1, 2, 10, 11, 11)] + [("r", None, "x"), (None, 1.0, "x")], "root string, ts double, n string").drop("n")
    assert sorted((r.started, r.ended, r.n) for r in batcher.sessions(ev).collect()) == [(0, 2, 3), (10, 11, 3)]
    long = spark.createDataFrame([("r", float(t)) for t in range(0, 130, 2)], "root string, ts double")
    assert sorted((r.started, r.ended, r.n) for r in batcher.capped_batches(long).collect()) == [(0, 60, 31), (62, 122, 31), (124, 128, 3)]
    assert batcher.capped_batches(long.limit(0)).isEmpty()


def test_stream_of_batches(spark, tmp_path):
    rows = spark.createDataFrame([("r", "/a.png", "modify", 0), ("r", "/b.png", "modify", 1), ("r", "/c.png", "access", 2), ("r", "/d.png", "create", 60), ("z", "/e.png", "create", 600)], "root string, path string, kind string, s int")
    rows.selectExpr("root", "path", "kind", "timestamp_seconds(s) as ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("root string, path string, kind string, ts timestamp").parquet(f"{tmp_path}/in")
    q = batcher.stream_batches(src).writeStream.format("memory").queryName("batches").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(sorted(r.paths) for r in spark.table("batches").collect()) == [["/a.png", "/b.png"], ["/d.png"]]


def test_store_end_to_end(spark, tmp_path):
    d = tmp_path / "img"
    (d / "sub").mkdir(parents=True)
    for n, t in (("a.png", "the invoice total is due"), ("b.PNG", "invoice draft"), ("c.txt", "no image")):
        (d / n).write_text("x")
        (d / f"{n}.txt").write_text(t)
    (d / "sub" / "e.jpg").write_text("x")
    store = IndexStore.open(spark, f"file://{tmp_path}/idx")
    assert store.stats()["file_count"] == 0 and store.search("invoice").isEmpty()
    assert index_directory(store, str(d)) == {"indexed": 2, "updated": 0, "failed": 1, "skipped": 0, "deleted": 0}
    os.remove(d / "b.PNG")
    (d / "sub" / "e.jpg.txt").write_text("")
    assert index_directory(store, str(d)) == {"indexed": 1, "updated": 0, "failed": 0, "skipped": 1, "deleted": 1}
    out = list(serve(store, ["invoice", "", ":snippet on", "total", ":limit 0", "AND", ":quit", "never"]))
    path = os.path.realpath(d / "a.png")
    assert out == [path, "", "", f"{path}\tthe invoice [total] is due", "", "error: :limit 0", "", "error: syntax error near 'AND'", ""]
    c = store.compact()
    assert c["reclaimed"] == c["before_bytes"] - c["after_bytes"] > 0 and store.search("invoice").count() == 1
    (tmp_path / "idx" / ".current.json.crc").unlink(missing_ok=True)
    (tmp_path / "idx" / "current.json").write_text('{"version": "v", "schema_version": "odd"}')
    with pytest.raises(IndexVersionError):
        IndexStore.open(spark, f"file://{tmp_path}/idx")


def test_directives():
    s = State(distance=2)
    assert directive(s, s, ":fuzzy on").matcher == "fuzzy" and directive(State(matcher="substring"), s, ":substring off").matcher == "standard"
    assert directive(s, s, ":limit x") is None and directive(s, s, ":fuzzy 9") is None


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    assert load(str(p)).default_limit == 20
    p.write_text('[index]\nmin_word_conf = 40\nlanguages = "eng+hrv"\nnew = 1\n[search]\ndefault_limit = 5\n')
    assert (load(str(p)).min_word_conf, load(str(p)).default_limit) == (40.0, 5)
    for bad in ("[index]\nworkers = -1", "[search]\ndefault_limit = 0", '[index]\nlanguages = "osd"', "[index]\nengine = 3", "nonsense"):
        p.write_text(bad)
        with pytest.raises(ConfigError, match="c.toml"):
            load(str(p))
    assert expanduser("~user/x") == "~user/x" and expanduser("~/x").endswith("/x")


def test_core_stands_alone():
    import subprocess
    import sys

    code = "import sys; sys.modules['pageloom.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_numbering_of_many_rows_with_other_columns(spark):
    n = 1_000_000
    rows = spark.range(n).selectExpr("concat('/', xxhash64(id)) as path", "repeat('x', int(id % 40)) as payload", "id % 3 as third").withColumn("_n", F.col("third"))
    got = I.numbered(rows.drop("_n"), [F.col("path")], "k", 5).agg(F.count("*").alias("rows"), F.countDistinct("k").alias("ids"), F.min("k").alias("low"), F.max("k").alias("high")).first()
    assert tuple(got) == (n, n, 5, n + 4)
    sizes = I.batches(rows.drop("_n")).groupBy("batch").count().groupBy("count").count().collect()
    assert [tuple(r) for r in sizes] == [(16, n // 16)]
    sample = sorted(r.path for r in I.strided_sample(rows.drop("_n")).collect())
    order = rows.select("path").orderBy("path").rdd.map(lambda r: r[0]).zipWithIndex().filter(lambda x: x[1] % (n // 33) == 0 and x[1] // (n // 33) < 33).keys().collect()
    assert sample == sorted(order)
    # one value of the order may hold a third of the rows
    hot = I.numbered(rows.drop("_n"), [F.col("third")], "k").groupBy("third").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.countDistinct("k").alias("n")).orderBy("third").collect()
    assert all(r.b - r.a + 1 == r.n for r in hot) and [r.a for r in hot] == [0, hot[0].n, hot[0].n + hot[1].n]


def test_upsert_of_many_rows(spark):
    n = 300_000
    files = spark.createDataFrame([(7, "/old", 1.0, "t0", None)], FILES)
    results = spark.range(n).selectExpr("concat('/', xxhash64(id)) as path", "1.0 as mtime", "'text' as status", "repeat('y', int(id % 50)) as text")
    got = I.upsert(files, results, "t1", "deu").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.max("id").alias("high")).first()
    assert tuple(got) == (n + 1, n + 1, n + 7)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    import json

    from pageloom import cli

    d, db = tmp_path / "img", f"file://{tmp_path}/idx"
    d.mkdir()
    for n, t in (("a.png", "the invoice total is due"), ("b.png", "invoice draft")):
        (d / n).write_text("x")
        (d / f"{n}.txt").write_text(t)
    (d / "bad.png").write_text("x")
    run = lambda *a: (cli.main(["--db", db, *a]), capsys.readouterr())
    code, out = run("index", str(d), "--failed-log", f"{tmp_path}/failed")
    assert code == 0 and json.loads(out.out)["failed"] == 1
    assert [r.value for r in spark.read.text(f"{tmp_path}/failed").collect()] == [f"{os.path.realpath(d / 'bad.png')}\tdecode or engine failure"]
    code, out = run("search", "total", "--json")
    hit = json.loads(out.out)
    assert code == 0 and list(hit) == ["path", "score", "mtime", "lang", "snippet"] and hit["snippet"] == "the invoice [total] is due"
    assert "snippet" not in json.loads(run("search", "total", "--json", "--no-snippet")[1].out)
    assert run("search", "xyzzy", "--open")[0] == 1
    code, out = run("search", "xyzzy", "--json")
    assert code == 0 and not out.out and "fuzzy" in out.err
    assert "a.png" in run("search", "totl", "--fuzzy")[1].out
    assert run("search", "AND")[0] == 2 and run("index", str(d), "--lang", "osd")[0] == 2 and run("index", str(d), "--min-conf", "101")[0] == 2
    assert json.loads(run("doctor", "--json")[1].out)["index"]["file_count"] == 2
    assert run("watch", str(tmp_path))[0] == 2  # the index lies inside
    monkeypatch.setenv("TESSDATA_PREFIX", str(tmp_path))
    (tmp_path / "eng.traineddata").write_text("x")
    assert run("lang", "list")[1].out == "eng\n" and run("lang", "remove", "eng")[0] == 2 and run("lang", "remove", "eng", "--yes")[0] == 0 and run("lang", "path")[1].out.strip() == str(tmp_path)


def test_watch_loop(spark, tmp_path):
    from pageloom.streaming.watch import watch

    d = tmp_path / "img"
    d.mkdir()

    def image(name, text, at):
        (d / name).write_text("x")
        (d / f"{name}.txt").write_text(text)
        os.utime(d / name, (at, at))

    image("a.png", "invoice total", 1000)
    image("b.png", "grocery list", 2000)
    store = IndexStore.open(spark, f"file://{tmp_path}/idx")
    index_directory(store, str(d))

    class Clock:
        now, k = 0.0, 0

        def time(self):
            return self.now

        def sleep(self, s):
            self.k += 1
            self.now += 2
            if self.k == 1:
                os.rename(d / "a.png", d / "moved.png")
                os.remove(d / "b.png")
                image("c.png", "storm warning", 3000)

    said = []
    got = list(watch(store, str(d), quiet=3.0, report=said.append, rounds=4, clock=Clock()))
    assert got == [{"renamed": 1, "deleted": 1, "indexed": 1, "failed": 0}] and said == ["ready"]
    assert [os.path.basename(r.path) for r in store.search("invoice").collect()] == ["moved.png"] and store.search("storm").count() == 1 and store.search("grocery").isEmpty()
