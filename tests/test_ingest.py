"""Ingestion on literal rows, with a hot group of copies."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftmap.functions import text as T
from driftmap.operators import ingest as G
from driftmap.operators import requests as Q
from driftmap.plans import derived


def test_quality(spark, rows):
    df = spark.createDataFrame([("aaaaaaaaaaaa",), ("abcabcabcabc",), ("abc",)], "content string")
    assert rows(G.quality(df)) == [("abcabcabcabc",)]


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 180, 181, 199, 200, 201, 380, 381, 1000])
def test_chunks_cover_every_word_once_past_the_overlap(spark, n):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, t string")
    got = [r["content"].split(" ") for r in G.chunk(df, "t", 200, 20).orderBy("chunk_no").collect()]
    words = [f"w{i}" for i in range(n)]
    assert (got[0] + [w for c in got[1:] for w in c[20:]] if got else []) == words
    assert all(len(c) <= 200 for c in got)
    assert all(len(c) > 20 for c in got[1:])  # no window inside the one before


def test_headings_split_and_stay(spark):
    text = "intro\n# One\na\n## Two\nb\n### Three\nc\n#no heading\n\n# \n"
    df = spark.createDataFrame([(1, text)], "doc_id long, page_content string")
    got = [(r["section"], r["section_text"]) for r in G.split_headings(df).orderBy("section").collect()]
    assert got == [(0, "intro"), (1, "# One\na"), (2, "## Two\nb\n### Three\nc\n#no heading"), (3, "#")]


def test_dedup_of_a_hot_group(spark):
    rng = random.Random(3)
    data = [(i, "same" if rng.random() < 0.5 else f"t{rng.randrange(40)}", f"m{i}") for i in range(600)]
    df = spark.createDataFrame(data, "pos long, content string, meta string").repartition(7)
    want = {}
    for pos, content, meta in data:
        first, _, n = want.get(content, (pos, None, 0))
        want[content] = (first, meta, n + 1)
    got = {r["content"]: (r["first_pos"]["pos"], r["meta"], r["copies"]) for r in G.dedup(df, ["pos"], ["meta"]).collect()}
    assert got == want


def test_merge_is_last_wins_and_idempotent(spark, rows):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    changes = spark.createDataFrame(
        [(1, 1, "x", "upsert"), (1, 2, "y", "upsert"), (2, 1, None, "delete"), (4, 1, "n", "upsert"), (5, 1, "n", "upsert"),
         (5, 2, None, "delete"), (3, 3, None, "upsert")],
        "k long, at long, v string, op string",
    )
    once = G.merge(target, changes, "k", ["v"], ["at"])
    assert rows(once) == sorted([(1, "y"), (3, None), (4, "n")], key=repr)
    assert rows(G.merge(once, changes, "k", ["v"], ["at"])) == rows(once)


def test_publish_swaps_then_retires(spark, rows, tmp_path):
    a, b = spark.range(3), spark.range(5)
    assert rows(G.publish(a, str(tmp_path), "live_docs", "v1")) == []
    assert rows(G.publish(b, str(tmp_path), "live_docs", "v2")) == [("v1",)]
    assert rows(G.publish(b, str(tmp_path), "live_docs", "v2")) == [("v1",)]  # a retry changes nothing
    assert G.current_version(spark, str(tmp_path), "live_docs").count() == spark.table("live_docs").count() == 5


def test_version_names(spark):
    df = spark.createDataFrame([("app", "m", dt.datetime(2024, 1, 2, 3, 4, 5))], "a string, m string, at timestamp")
    assert df.select(G.version_name(F.col("a"), F.col("m"), at=F.col("at")).alias("v")).first()["v"] == "app-m-2024-01-02-03-04-05"


def test_html_rules(spark):
    html = '<head><title>t</title></head><h1>A_b</h1><p>x <b>y</b> <img src="z"><a href="/l">in</a></p><ul><li>1</li></ul>&amp;lt;<!-- c --><script>s()</script>'
    got = spark.createDataFrame([(html,)], "h string").select(T.html_to_text(F.col("h")).alias("t")).first()["t"]
    assert got == "# Ab\n\nx **y** [in](/l)\n\n* 1\n\n&lt;"


def test_strip_takes_every_white_space(spark):
    df = spark.createDataFrame([(" \n\t x y  \r\n",)], "c string")
    assert df.select(T.strip(F.col("c")).alias("c")).first()["c"] == "x y"


def test_clean_reply(spark):
    df = spark.createDataFrame([("```mermaid\ngraph é\n```",)], "c string")
    assert df.select(T.clean_diagram_reply(F.col("c")).alias("c")).first()["c"] == "\ngraph \n"


def test_metadata_block(spark):
    df = spark.createDataFrame([("n", None, "o"), (None, "", None)], "n string, p string, o string")
    got = [r["b"] for r in df.select(Q.metadata_block({"name": F.col("n"), "purpose": F.col("p"), "owner": F.col("o")}).alias("b")).collect()]
    assert got == [f"\n    {Q.METADATA_HEADER}\n    - Pipeline Name: n\n    - Owner: o\n", ""]


def test_numbered_steps_and_bracket_counts(spark):
    df = spark.createDataFrame([("1. a\n  22. b\nx 3. c\n4.d\n5. \n",)], "c string")
    assert df.select(T.count_numbered_steps(F.col("c")).alias("n")).first()["n"] == 3


def test_derived_diagrams_are_bounded_and_grow(spark):
    sizes = [derived.diagrams(spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01")]
    assert sizes == [25, 50]


def test_fenced_lines_are_no_headings(spark):
    text = "# A\nx\n```py\n# no\n## no\n```\ny\n## B\nz"
    df = spark.createDataFrame([(1, text)], "doc_id long, page_content string")
    assert [r["section_text"] for r in G.split_headings(df).orderBy("section").collect()] == ["# A\nx\n```py\n# no\n## no\n```\ny", "## B\nz"]


def test_underlined_source_keeps_underscores(spark):
    html = "<h1>Our_shop</h1><p>a = b_c</p><h3>More_x</h3>"
    got = spark.createDataFrame([(html,)], "h string").select(T.html_to_text(F.col("h"), underlined=True), T.html_to_text(F.col("h"))).first()
    assert tuple(got) == ("Our_shop\n\na  b_c\n\n### More_x", "# Ourshop\n\na = bc\n\n### Morex")
