"""Source trees, ignore rules, feeds, run logs and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from driftmap.functions.keywords import steps_named_in
from driftmap.operators import reports as R
from driftmap.sources import feeds as E
from driftmap.sources import pages as P
from driftmap.sources import reports as L
from driftmap.sources import tree as T
from driftmap.streaming import updates as U


def paths(spark, *names):
    return spark.createDataFrame([("r", n) for n in names], "repo_id string, path string")


def test_scan_reads_text_and_marks_binary(spark, rows, tmp_path):
    (tmp_path / "a" / ".hid").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_text("é = 1")
    (tmp_path / "a" / "y.js").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "a" / "z.md").write_text("no")
    (tmp_path / ".env").write_text("E=1")
    got = T.scan_files(spark, {"r": str(tmp_path)}, [".py", ".js"])
    assert rows(got.select("repo_id", "path", "ext", "content", "readable")) == [
        ("r", "a/x.py", ".py", "é = 1", True), ("r", "a/y.js", ".js", None, False)
    ]


def test_a_fleet_is_one_read(spark, rows, tmp_path):
    for repo in ("one", "two"):
        (tmp_path / repo / "src").mkdir(parents=True)
        (tmp_path / repo / "src" / "m.py").write_text(f"n = '{repo}'")
    want = [("one", "src/m.py", "n = 'one'"), ("two", "src/m.py", "n = 'two'")]
    assert rows(T.scan_fleet(spark, str(tmp_path), [".py"]).select("repo_id", "path", "content")) == want
    roots = {r: str(tmp_path / r) for r in ("one", "two")}
    assert rows(T.scan_files(spark, roots).select("repo_id", "path", "content")) == want


def test_hidden_directories_go_hidden_files_stay(spark, rows):
    f = paths(spark, ".git/x", "a/.b/c.py", ".env", "a/.env", "a.b/c", "x.py")
    assert rows(T.prune_hidden(f).select("path")) == [(".env",), ("a.b/c",), ("a/.env",), ("x.py",)]


def test_extensions_follow_the_last_suffix(spark):
    names = {"a.py": ".py", "a.tar.gz": ".gz", ".bashrc": "", ".env.local": ".local", "x": "", "d.e/x": "", "foo.": "."}
    got = {r["path"]: r["e"] for r in paths(spark, *names).select("path", T.extension(F.col("path")).alias("e")).collect()}
    assert got == names


def test_ignore_last_match_wins(spark, rows):
    rules = spark.createDataFrame(
        [("r", 1, r"\.log$", False), ("r", 2, "^keep/", True), ("r", 3, "^keep/no", False)],
        "repo_id string, seq int, regex string, negated boolean",
    )
    f = paths(spark, "a.log", "keep/a.log", "keep/no.log", "b.py").unionByName(
        spark.createDataFrame([("other", "a.log")], "repo_id string, path string")
    )
    assert rows(T.apply_ignore(f, rules)) == [("other", "a.log"), ("r", "b.py"), ("r", "keep/a.log")]


def test_changed_paths_with_either_slash(spark, rows):
    assert rows(T.only_paths(paths(spark, "a\\b.py", "a/c.py", "d.py"), paths(spark, "a/b.py", "a\\c.py"))) == [
        ("r", "a/c.py"), ("r", "a\\b.py")
    ]


def test_structure_counts_parents(spark, rows):
    f = paths(spark, "a/b/c.py", "a/d.js", "e.md", ".git/x", "LICENSE", "s/.c/t/u.py")
    assert rows(R.structure(f)) == [("r", 4, 3)]
    assert rows(R.file_types(f)) == [("r", ".js", 1), ("r", ".md", 1), ("r", ".py", 1)]
    many = paths(spark, *[f"d{i:02}/x" for i in range(30)])
    assert [r["dir"] for r in R.top_dirs(many).orderBy("rank").collect()] == [f"d{i:02}" for i in range(20)]


def test_entry_points_are_case_sensitive(spark, rows):
    f = paths(spark, "main.py", "a/Main.java", "a/main.java", "b/index.ts", "Main.py")
    assert rows(R.entry_points(f).select("path", "language")) == [
        ("a/Main.java", "java"), ("b/index.ts", "typescript"), ("main.py", "python")
    ]


def test_articles_stop_at_the_first_empty_page(spark, rows):
    def body(*titles):
        return json.dumps({"result": [{"title": t, "status": "published"} for t in titles]})

    pages = spark.createDataFrame(
        [("f", 1, body("a", "b")), ("f", 2, body("c")), ("f", 3, body()), ("f", 4, body("late")), ("g", 1, body("z"))],
        "feed string, page long, body string",
    )
    assert rows(E.read_articles(pages).select("feed", "title")) == [("f", "a"), ("f", "b"), ("f", "c"), ("g", "z")]


def test_run_log_of_both_outcomes(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("a", "j", t, t + dt.timedelta(seconds=61.9), 5, 2, "in", "vec", "ns", None),
         ("a", "j", t, t + dt.timedelta(seconds=3), 5, 2, "in", "vec", "ns", "boom")],
        "application_name string, job_name string, started timestamp, ended timestamp, num_embeddings int, num_new_embeddings int,"
        "input_file string, output_type string, output_name string, error string",
    )
    good, bad = sorted(L.run_log_rows(df).collect(), key=lambda r: r["status"], reverse=True)
    assert (good["duration_in_seconds"], good["num_embeddings"], good["output"][0]["name"]) == (61, 5, "ns")
    assert (bad["status"], bad["num_embeddings"], bad["output"], bad["error"]) == ("failed", None, None, "boom")


def test_page_files_hold_the_diagram(spark, tmp_path):
    d = spark.createDataFrame([("one", "graph TD\nA[x]")], "diagram_id string, code string")
    P.export_page_files(d, str(tmp_path / "out"))
    (page,) = (tmp_path / "out" / "diagram_id=one").glob("*.txt")
    assert page.read_text().startswith(P.PAGE_HEAD + "graph TD\nA[x]")


def test_stream_equals_batch_and_a_rerun_adds_nothing(spark, rows, tmp_path):
    data = spark.createDataFrame([(i, f"d/{n}") for i, n in enumerate(["load.py", "load.md", "split.js", "zz.ts"])], "event_id long, path string")
    data.repartition(3).write.parquet(str(tmp_path / "in"))

    def step(df):
        return df.select("event_id", F.explode(steps_named_in(T.base_name(F.col("path")))).alias("step"))

    for _ in range(2):
        U.stream_updates(spark, str(tmp_path / "in"), data.schema, str(tmp_path / "out"), str(tmp_path / "st"), step, max_files=1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert rows(got) == rows(step(T.filter_ext(data, T.CHANGED_EXTENSIONS)))


def test_stream_ingest_merges_copies_over_batches(spark, tmp_path):
    base = str(tmp_path)
    docs = [spark.createDataFrame(r, "doc_id long, text string").coalesce(1) for r in ([(1, "a"), (2, "b")], [(3, "a"), (4, "known")])]
    known = spark.createDataFrame([(9, "known", [1.0])], "doc_id long, text string, embedding array<float>")
    U.cache_of(known, "text", "embedding", "doc_id").write.parquet(f"{base}/cache")
    for part in docs:
        part.write.mode("append").parquet(f"{base}/in")
        U.stream_ingest(spark, f"{base}/in", part.schema, f"{base}/cache", f"{base}/out", f"{base}/st", "text", 1).awaitTermination()
    got = {r["content"]: (r["doc_id"], r["embedding"], r["n_fresh"]) for r in U.merged_batches(spark, f"{base}/out").collect()}
    assert got == {"a": (3, None, 1), "b": (2, None, 1), "known": (4, [1.0], 0)}


def test_scan_keeps_every_name(spark, rows, tmp_path):
    for name in ("main.py", "__main__.py", "__init__.py", ".eslintrc.js", "_private/a.py", ".git/hooks/x.py"):
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    got = rows(T.scan_fleet(spark, str(tmp_path)).select("repo_id", "path", "content"))
    assert got == sorted(("repo", n, n) for n in ("main.py", "__main__.py", "__init__.py", ".eslintrc.js", "_private/a.py", ".git/hooks/x.py"))
    assert rows(T.prune_hidden(T.scan_fleet(spark, str(tmp_path))).select("path")) == sorted(
        [("main.py",), ("__main__.py",), ("__init__.py",), (".eslintrc.js",), ("_private/a.py",)]
    )
