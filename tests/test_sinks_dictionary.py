"""Sinks that can run again, counters, large dictionaries, and the native comment scan."""

import random

import pytest
from pyspark.sql import functions as F

from driftmap.functions.keywords import with_keyword_tags
from driftmap.operators import dictionary
from driftmap.operators import facts as A
from driftmap.operators import keyed
from driftmap.plans import derived, ingest_queries
from driftmap.sources import changesets as S
from driftmap.sources import reports as R

SF = "/root/testdata/sf0.001"


def test_contained_equals_plain(spark, rows):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(n))
    texts = [(i % 3, make(rng.choice([0, 1, 2, 5, 300, 900]))) for i in range(60)] + [(None, "abc"), (1, None)]
    words = [(rng.randrange(3), make(rng.choice([0, 1, 2, 3, 4, 6]))) for _ in range(200)] + [(0, None), (None, "a"), (2, texts[4][1][:290])]
    t = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(texts)], "id long, k long, text string")
    w = spark.createDataFrame(words, "k long, word string")
    got = rows(dictionary.contained(t, w, ["k"]))
    want = {(i, k, x) for i, (k, text) in enumerate(texts) if text is not None for kk, x in words if k is not None and kk == k and x and x in text}
    assert got == sorted(want, key=repr) and len(got) > 500
    assert rows(dictionary.contained(t.select("id", "text"), w.select("word").limit(0))) == []


def test_50000_keywords(spark, rows):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou"]
    words = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(90_000)})[:50_000]
    assert len(words) == 50_000
    table = spark.createDataFrame([(w, f"s{len(w)}") for w in words], "word string, step string")
    tagged = dictionary.dictionary_tags(docs, table, "doc_id")
    plan = tagged._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and len(plan) < 60_000
    some = docs.limit(4)
    steps = {}
    for w in words[::5]:
        steps.setdefault(f"s{len(w)}", []).append(w)
    sample = dictionary.dictionary_tags(some, table.where(F.col("word").isin(words[::5][:2_000])), "doc_id")
    chosen = set(words[::5][:2_000])
    literal = with_keyword_tags(some, "text", "tags", {s: [w for w in ws if w in chosen] for s, ws in steps.items() if any(w in chosen for w in ws)})
    want = sorted(((r["doc_id"], r["tags"]) for r in literal.select("doc_id", "tags").collect() if r["tags"]), key=repr)
    assert sorted(((r["doc_id"], r["tags"]) for r in sample.collect()), key=repr) == want
    text = {r["doc_id"]: r["text"].lower() for r in docs.collect()}
    got = {r["doc_id"]: set(r["tags"]) for r in tagged.collect()}
    for i in sorted(text)[:20]:
        assert {t for t in got.get(i, set()) if not t.startswith("s") or not t[1:].isdigit()} == {w for w in words if w in text[i]}


def test_routing_is_one_scan(spark, tmp_path):
    replies = spark.createDataFrame(
        [("a", "d", '{"changes": []}'), ("b", " ", '{"changes": []}'), ("c", "d", "no json"), ("d", "d", None), (None, None, "x")],
        "change_id string, diff_text string, reply string",
    )
    replies.write.parquet(f"{tmp_path}/in")
    stored = spark.read.parquet(f"{tmp_path}/in")
    for _ in range(2):
        routed = S.route_replies(stored, f"{tmp_path}/out")
    got = {r["change_id"]: (r["outcome"], r["reason"], r["reply"]) for r in routed.collect()}
    assert got == {
        "a": ("good", None, '{"changes": []}'), "b": ("quarantine", "none", '{"changes": []}'), "c": ("quarantine", "unknown", "no json"),
        "d": ("quarantine", "unknown", None), None: ("quarantine", "none", "x"),
    }
    assert sorted(p.name for p in (tmp_path / "out").glob("outcome=*")) == ["outcome=good", "outcome=quarantine"]
    assert routed.where("outcome = 'good'").inputFiles() and routed.count() == 5


def test_reports_by_run(spark, tmp_path):
    path = str(tmp_path / "r")
    for run, n in (("a", 3), ("b", 4), ("a", 2)):
        R.write_report(spark.range(n).withColumnRenamed("id", "repo_id"), path, run)
    assert {(r["run_id"], r["n"]) for r in spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {("a", 2), ("b", 4)}


def test_log_by_run(spark, tmp_path):
    columns = (
        "run_id string, application_name string, job_name string, started timestamp_ntz, ended timestamp_ntz, num_embeddings long, num_new_embeddings long, "
        "input_file string, output_type string, output_name string, error string"
    )
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    row = lambda run, end, error=None: (run, "a", "j", t, t + dt.timedelta(seconds=end), 5, 1, "f", "v", "ns", error)
    for part in ([row("x", 1, "boom"), row("y", 2)], [row("x", 9)], [row("x", 9), row("z", 1, "late"), row("z", 3)]):
        R.log_runs(R.run_log_rows(spark.createDataFrame(part, columns).withColumns({c: F.col(c).cast("timestamp") for c in ("started", "ended")}), "run_id"), str(tmp_path), 4)
    got = {r["run_id"]: (r["status"], r["duration_in_seconds"]) for r in keyed.read(spark, str(tmp_path)).collect()}
    assert got == {"x": ("success", 9), "y": ("success", 2), "z": ("success", 3)}


def test_run_counters_equal_counts(spark, rows):
    assert rows(ingest_queries.agg11_run(spark, SF)) == rows(ingest_queries.agg11(spark, SF))


SOURCES = [
    derived.QUOTED, 'x = """a\n#b""" # c\n', "y = '#' + \"#\"  # d\n", "s = '''\\'''#''' #e\n", 'f("""', "# only", "", 'a = ""\nb = "" # x\n', "z = 'it' # don't\nw = 1 # \"q\n",
    'm = "a\\\n# in"  # out\n', 'r"""\\""" # still in """ # now\n', "k = '''a''' '''#''' # t\n", 'q = "#\\\\" # p\n',
]


def test_scanned_comments_equal_parsed(spark, rows):
    df = spark.createDataFrame([("r", f"{i}.py", s) for i, s in enumerate(SOURCES)], "repo_id string, path string, content string")
    good = df.where("path <> '4.py'")
    assert rows(A.scanned_comments(good)) == rows(A.parsed_comments(A.parse_files(good)))
    assert rows(A.scanned_comments(df.where("path = '4.py'"))) == []


@pytest.mark.parametrize("text", ["\"" + "a\\n" * 700_000 + "\" # c", "'''" + "x'" * 1_000_000 + " ''' # c", "a" * 2_000_000 + " # c", "\"\"\"" + "\\\"" * 1_000_000])
def test_long_strings_are_scanned(spark, text):
    df = spark.createDataFrame([("r", "a.py", text)], "repo_id string, path string, content string")
    assert [r["text"] for r in A.scanned_comments(df).collect()] == (["c"] if text.endswith("c") else [])


def test_blocks_are_dealt_and_grams_known(spark, rows, monkeypatch):
    """Texts of one task are dealt before their q-grams are cut; a pattern of known q-grams finds what all of them find."""
    odd = ["a.b+c", "x]^-[y", "\\E\\Q\\", "\U0001f600\U0001f601 z", "é", "-", "^]", "a\nb\nc"]
    texts = spark.createDataFrame(
        [*((i, f"{w} plain text {w}{w}") for i, w in enumerate(odd)), (99, "abcdabcde"), (100, None), (101, "")], "key long, text string"
    ).coalesce(1)
    words = spark.createDataFrame([(w,) for w in [*odd, "abcd", "bcdabc", "zzzz", "b", "", None]], "word string")
    found = dictionary.contained(texts, words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(key" in plan and "BroadcastHashJoin" in plan
    listed = [(r["key"], r["text"]) for r in texts.collect()]
    want = sorted({(k, w) for k, t in listed for (w,) in words.collect() if t and w and w in t}, key=repr)
    assert rows(found) == want
    monkeypatch.setattr(dictionary, "KNOWN", 2)
    monkeypatch.setattr(dictionary, "SENT_ROWS", 2)
    found = dictionary.contained(texts, words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert rows(found) == want
