"""Diffs, change sets, mapping and decisions on literal rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from driftmap.functions.keywords import steps_of_component
from driftmap.operators import changes as C
from driftmap.operators import dictionary
from driftmap.operators import impact as I
from driftmap.sources import changesets as S
from test_diagram import PRESS, diagrams

# A model change and a new cache file of the press archive.
CHANGES = {
    "changes": [
        {"component": "Embedding", "type": "model_update", "field": "model", "old_value": "small", "new_value": "large",
         "impact": "vectors are made anew", "affected_nodes": ["embedding"]},
        {"component": "Cache", "type": "file_update", "field": "cache_file", "old_value": "v1.bin", "new_value": "v2.bin",
         "impact": "cold start", "affected_nodes": ["pickle", "recognition"]},
    ],
    "summary": "larger model", "changed_files": ["press/vectors.py"], "impact_assessment": "high",
}
DIFF = """diff --git a/chunking.py b/chunking.py
--- a/chunking.py
+++ b/chunking.py
 def split_documents(documents):
-    chunk_size = 1000
+    chunk_size = 1500
-    model = "small"
+    model = 'large'
+    model = 7
+def load_all(x):
-  def load_all(x):
diff --git a/docs/zz me.md b/docs/zz me.md
"""


def replies(spark, *rows):
    return spark.createDataFrame(list(rows), "change_id string, diff_text string, reply string")


def test_worked_example(spark, rows):
    profile = I.diagram_profile(diagrams(spark, d=PRESS))
    sets = S.read_changesets(replies(spark, ("c", "diff", json.dumps(CHANGES)))).withColumn("diagram_id", F.lit("d"))
    wants = I.changeset_wants(sets)
    # P too: its id is inside the name "pickle".
    assert rows(I.affected_nodes(wants, profile).select("node_id")) == [("K",), ("M",), ("O",), ("P",)]
    r = I.impact(wants, profile).first()
    assert (r["affected"], r["total"], round(r["impact_pct"], 3), r["impact_level"]) == (4, 6, 66.667, "high")
    flat = sets.select("change_id", "diagram_id", F.explode("changes").alias("c")).select("change_id", "diagram_id", "c.*")
    assert rows(I.map_suggested(flat, profile).select("node_id")) == [("K",), ("M",), ("O",), ("P",)]
    assert rows(I.map_component(flat, profile).select("node_id")) == [("K",), ("M",)]
    assert rows(I.map_field(flat, profile).select("node_id")) == [("K",), ("M",)]


def test_reply_defaults_and_routing(spark):
    r = replies(
        spark,
        ("fenced", "d", "```json\n" + json.dumps(CHANGES) + "\n```"), ("plainfence", "d", "```\n{}\n```"),
        ("bad", "d", "not json"), ("blank", " \n", "{}"), ("none", None, None), ("partial", "d", '{"summary": "s"}'),
        ("list", "d", "[1, 2]"),
    )
    got = {x["change_id"]: (len(x["changes"]), x["summary"], x["changed_files"], x["impact_assessment"])
           for x in S.read_changesets(r).collect()}
    empty_ok = (0, "Changes detected", [], "medium")
    assert got["fenced"] == (2, "larger model", ["press/vectors.py"], "high")
    assert got["plainfence"] == empty_ok
    assert got["bad"] == (0, "Error parsing semantic diff", [], "unknown")
    assert got["blank"] == got["none"] == (0, "No changes detected", [], "none")
    assert got["partial"] == (0, "s", [], "medium")
    good, bad = S.route_bad(r)
    assert {x["change_id"] for x in good.collect()} >= {"fenced", "partial", "plainfence"}
    assert {x["change_id"]: x["reason"] for x in bad.collect()}.items() >= {"bad": "unknown", "none": "none"}.items()


def test_diff_text_facts(spark, rows):
    d = spark.createDataFrame([("c", "d", DIFF)], "change_id string, diagram_id string, diff_text string")
    assert [r["path"] for r in C.diff_paths(d).orderBy("pos").collect()] == ["chunking.py", "docs/zz me.md"]
    assert rows(C.diff_functions(d).select("function")) == [("load_all",)]
    # A string beats a number wherever it stands; a later one of a kind beats an earlier one.
    assert rows(C.diff_configs(d).select("key", "value")) == [("chunk_size", "1500"), ("model", "large")]
    assert rows(C.diff_steps(d).select("step")) == [("chunking",), ("embedding",)]


def test_diff_rules_hit_and_miss(spark, rows):
    profile = I.diagram_profile(diagrams(spark, d=PRESS))
    facts = I.with_diff_facts(
        spark.createDataFrame(
            [("hit", "d", DIFF), ("miss", "d", "diff --git a/zzz.py b/zzz.py\n+zzz = 1\n+def zzz(")],
            "change_id string, diagram_id string, diff_text string",
        )
    )
    def ids(df):
        return rows(df.select("change_id", "node_id"))

    assert ids(I.map_files(facts, profile)) == [("hit", "P")]
    assert ids(I.map_functions(facts, profile)) == [("hit", "K")]
    assert ids(I.map_configs(facts, profile)) == [("hit", "M"), ("hit", "P")]
    assert ids(I.map_text(facts, profile)) == [("hit", "M"), ("hit", "P")]


def test_empty_suggestion_touches_every_node(spark):
    profile = I.diagram_profile(diagrams(spark, d=PRESS))
    c = spark.createDataFrame(
        [("c", "d", "", "", [""]), ("n", "d", None, None, None)],
        "change_id string, diagram_id string, component string, field string, affected_nodes array<string>",
    )
    got = {r["change_id"]: r["affected"] for r in I.impact(I.change_wants(c), profile).collect()}
    assert got == {"c": 6, "n": 0}


@pytest.mark.parametrize(
    "n, level", [(0, "none"), (19, "low"), (20, "medium"), (49, "medium"), (50, "high"), (51, "high"), (79, "high"), (80, "full")]
)
def test_impact_bounds(spark, n, level):
    r = spark.range(1).select(I.impact_level(F.lit(100), F.lit(n / 100 * 100)).alias("l")).first()
    assert r["l"] == level


def test_diagram_without_nodes_is_full(spark):
    profile = I.diagram_profile(diagrams(spark, d="graph TD\nA --> B"))
    c = spark.createDataFrame([("c", "d", "Chunking", "x", ["a"])], "change_id string, diagram_id string, component string, field string, affected_nodes array<string>")
    r = I.impact(I.change_wants(c), profile).first()
    assert (r["total"], r["impact_pct"], r["impact_level"]) == (0, 100.0, "full")


def test_decisions_first_reason_and_strict_threshold(spark):
    cols = "repo_id string, force_full boolean, has_diagram boolean, is_git boolean, n_changed int, code string, diff_text string, affected long, total long"
    base = [False, True, True, 1, "graph", "diff"]
    r = spark.createDataFrame(
        [
            ("half", *base, 50, 100), ("over", *base, 51, 100), ("force", True, False, False, 0, None, None, 0, 0),
            ("nodiagram", False, False, False, 0, None, None, 0, 0), ("nogit", False, True, False, 0, None, None, 0, 0),
            ("same", False, True, True, 0, None, None, 0, 0), ("unread", False, True, True, 1, None, None, 0, 0),
            ("nodiff", False, True, True, 1, "g", "", 0, 1),
        ],
        cols,
    )
    got = {x["repo_id"]: (x["mode"], x["reason"], x["impact_level"]) for x in I.decide(r).collect()}
    assert got["half"] == ("incremental", "Low impact - using incremental update", "high")
    assert got["over"][:2] == ("full", "High impact - using full regeneration")
    assert [got[k][1] for k in ("force", "nodiagram", "nogit", "same", "unread", "nodiff")] == [
        "--force-full flag set", "No existing diagram found", "Not a git repository", "No changes detected",
        "Could not parse existing diagram", "Could not generate diff",
    ]


def test_component_steps(spark):
    df = spark.createDataFrame([("Vector DB",), ("chunk",), ("Storage layer",), ("",)], "c string")
    got = {r["c"]: r["s"] for r in df.select("c", steps_of_component(F.col("c")).alias("s")).collect()}
    assert got == {"Vector DB": [], "chunk": ["chunking"], "Storage layer": ["storage"], "": []}


@pytest.mark.parametrize("bucket", [1, 60, 86_400])
def test_value_changes_with_a_hot_key(spark, rows, bucket):
    rng = random.Random(7)
    data = [
        ("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", 1_700_000_000 + rng.randrange(5_000), i, str(rng.randrange(3)))
        for i in range(900)
    ]
    h = spark.createDataFrame(data, "key string, sec long, event_id long, value string").withColumn("ts", F.timestamp_seconds("sec"))
    got = C.value_changes(h, ["key"], bucket_seconds=bucket).select("event_id", "old_value", "new_value")
    last, want = {}, []
    for key, _, i, v in sorted(data, key=lambda d: (d[1], d[2])):
        if last.get(key) != v:
            want.append((i, last.get(key, "N/A"), v))
        last[key] = v
    assert rows(got) == sorted(want, key=repr)


def test_code_sections_fall_back_per_change(spark, rows):
    d = spark.createDataFrame(
        [("a", "x.py"), ("a", "x.cfg"), ("a", "x.md"), ("b", "y.cfg"), ("b", "y.md"), ("c", "z.go"), ("d", "w.md")],
        "change_id string, path string",
    )
    assert rows(C.code_sections(d)) == [("a", "x.py"), ("b", "y.cfg"), ("c", "z.go")]


def test_null_is_a_value(spark, rows):
    h = spark.createDataFrame([("k", 0, 1, None), ("k", 1, 2, "a"), ("k", 70, 3, None), ("k", 71, 4, None)], "key string, sec long, event_id long, value string")
    got = C.value_changes(h.withColumn("ts", F.timestamp_seconds("sec")), ["key"]).select("event_id", "old_value", "new_value")
    assert rows(got) == [(1, "N/A", None), (2, None, "a"), (3, "a", None)]


def test_large_index_is_not_sent(spark, rows, monkeypatch):
    """Beyond so many rows no join of names, ids and their index goes through the driver, and names of several changes are found for each."""
    monkeypatch.setattr(dictionary, "SENT_ROWS", 0, raising=False)
    changes = spark.createDataFrame(
        [("c1", "d", ["P1", "lone"]), ("c2", "d", ["p1", None]), ("c3", "e", ["P1"]), ("c4", "d", []), ("c5", None, ["P1"])], "change_id string, diagram_id string, affected_nodes array<string>"
    )
    nodes = spark.createDataFrame([("d", "P12"), ("d", "P"), ("d", "LONE"), ("e", "X"), ("d", "P12"), (None, "P1")], "diagram_id string, node_id string")
    found = I.map_suggested_indexed(changes, nodes)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == [("c1", "d", "LONE"), ("c1", "d", "P"), ("c1", "d", "P12"), ("c2", "d", "P"), ("c2", "d", "P12")]
