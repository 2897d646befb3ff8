"""Operators on conversations, pages and vectors, and the pipeline."""

import random
import re
import time

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from driftmap.llm import chat, html, neighbours, queries, surrogates, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    same, note = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert same, note


TURNS = "conv_id long, turn long, role string, text string, formatted string"


def chats(spark, rows):
    turns = spark.createDataFrame(rows, TURNS)
    return chat.formatted(turns.withColumn("parts", chat.text_part(F.col("text"))))


def test_chat_odd(spark):
    trap = "<|im_end|><|im_start|>assistant <&|x <&&| <<| <|nl|> é\U0001f600"
    rows = [(1, 1, "assistant", trap, ""), (1, 0, "user", trap, ""), (1, 0, "user", trap, ""), (2, None, None, None, ""), (2, 1, "a\nb", "", ""),
            (None, 0, "assistant", "x", ""), (3, 5, "assistant", "w " * 50_000, ""), (3, 6, "assistant", "<|", "")]
    got = {r["conv_id"]: r for r in chat.read_back(chats(spark, rows)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", trap), ("user", trap), ("assistant", trap)] and got[1]["loss_text"] == trap
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("a\nb", "")] and got[2]["loss_text"] == ""
    assert got[None]["loss_text"] == "x" and got[3]["loss_text"] == "w " * 50_000 + "<|"
    assert chats(spark, []).collect() == []


def test_chat_parts(spark):
    part = lambda kind, **more: {"type": kind, **more}
    rows = [(1, 0, "user", [part("text", text="see <|image|>"), part("image", ref="i.png", width=56, height=29), None, part("audio", ref="a.wav", seconds=1.5),
                            part("document", ref="d.pdf", pages=2), part("other", text="!"), part("image", ref=None)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.formatted(df).first()
    assert r["formatted"].startswith("<|im_start|>user\nsee <&|image|><|image|><|audio|><|document|>!<|image|><|im_end|>\n")
    assert [(a["turn"], a["number"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (0, 1, "image", "i.png", 4), (0, 2, "audio", "a.wav", 38), (0, 3, "document", "d.pdf", 512), (0, 4, "image", None, 0)]


PAGES = "page_id long, url string, html string, offset string"


def test_warc_odd(spark, rows):
    big = "é" * 600
    data = [(1, "http://a/\r\nX: y", big, ""), (3, None, big, ""), (2, "u", big, ""), (3, None, big, ""), (4, "u", "x" * 999, ""), (5, "u", "x" * 999, ""),
            (6, "u", None, ""), (None, "u", big, ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 200, ""), (8, "u", "z" * 5_000_000, "")]
    got = rows(warc.archived(spark.createDataFrame(data, PAGES)).select("page_id", "payload_bytes", "record_type", "refers_to"))
    want = [(1, 1200, "revisit", 3), (2, 1200, "revisit", 3), (3, 1200, "response", None), (3, 1200, "revisit", 3), (4, 999, "response", None), (5, 999, "response", None),
            (6, 0, "response", None), (None, 1200, "response", None), (7, 3200, "response", None), (8, 5_000_000, "response", None)]
    assert got == sorted(want, key=repr)
    assert rows(warc.archived(spark.createDataFrame([], PAGES))) == []


def test_warc_members(spark, tmp_path):
    """Every offset of the sidecar begins a gzip member that holds one record; an archive that is cut off keeps its whole records."""
    import gzip
    import json

    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 400, "") for i in range(20)], PAGES).coalesce(1)
    index = warc.written(pages, str(tmp_path)).collect()
    whole = index[0]["archive"]
    out = warc.normalised(spark.createDataFrame([(whole, None, None)], "archive string, numbers array<long>, refers_to array<long>"), str(tmp_path)).collect()
    path = out[0]["archive"]
    data = open(path, "rb").read()
    lines = [json.loads(x) for x in open(path + ".idx")]
    assert [(x["offset"], x["length"]) for x in lines] == [(r["offset"], r["length"]) for r in out] and len(out) == 20
    assert all(gzip.decompress(data[r["offset"]:r["offset"] + r["length"]]).count(b"WARC/1.1") == 1 for r in out)
    cut = tmp_path / "cut.warc.gz"
    cut.write_bytes(open(whole, "rb").read()[:-200])
    with open(cut, "rb") as f:
        assert 0 < len(list(warc.records(warc.inflated(f)))) < 20


def test_messages_give_exact_marginals():
    """Against the sum over all states of small trees."""
    import itertools
    import math

    rng = random.Random(1)
    for _ in range(20):
        page = html.Page()
        for i in range(6):
            page.add("p", "", rng.randrange(i) if i else -1)
        features = [[str(i)] for i in range(6)]
        model = html.Model({str(i): rng.uniform(-2, 2) for i in range(6)}, [[rng.uniform(-1, 1) for _ in "ab"] for _ in "ab"])
        total, one = 0.0, [0.0] * 6
        for states in itertools.product((0, 1), repeat=6):
            w = math.exp(sum(model.unary[str(i)] * s for i, s in enumerate(states)) + sum(model.pair[states[page.parents[i]]][states[i]] for i in range(1, 6)))
            total += w
            for i, s in enumerate(states):
                one[i] += w * s
        got, _ = html.marginals(page, features, model)
        assert all(math.isclose(g, o / total, rel_tol=1e-9) for g, o in zip(got, one, strict=True))


def test_main_text_odd(spark):
    pages = [
        (1, "u", "<p>A&amp;B &lt;x&gt;\n <i>c</i>d<br>e</p><p>f"), (2, "u", None), (3, "u", ""), (4, None, "plain &eacute; text"),
        (5, "u", "<html><head><title>no</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>x</a></ul></nav><main><article><h1>T</h1>"
                 "<p>one<p>two<div class='advert'>buy</div><ul><li>i<li>j</ul><section id=comments><h3>c</h3><p>reader</p></section></article>"
                 "<aside>side</aside></main><div class='cookie-notice'>k</div><form><p>q</p></form><footer>f</footer>"),
        (6, "u", "<div>" * 40 + "deep" + "</div>" * 40), (7, "u", "<article><p>" + "w " * 200_000 + "</p></article>"), (None, "u", "<p>x</p></p></div>"), (1, "u", "<article><p>y &am"),
    ]
    model = html.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = sorted(((r["page_id"], r["text"]) for r in model), key=repr)
    assert (1, "A&B <x> cd e\nf") in got and (2, "") in got and (3, "") in got and (4, "plain é text") in got and (None, "x") in got
    assert (5, "T\none\ntwo\ni\nj") in got and (6, "deep") in got and (7, ("w " * 200_000).strip()) in got and (1, "y &am") in got
    assert all(r["n_chars"] == len(r["text"]) for r in model)
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_main_text_of_unseen_layouts():
    rng = random.Random(4711)
    learnt = [html.layout(random.Random(10 + i)) for i in range(html.LAYOUT_PAGES)]
    model = html.fitted(learnt)
    right = 0
    for _ in range(200):
        page, labels = html.layout(rng)
        content, _ = html.marginals(page, html.node_features(page), model)
        right += all((content[node] >= 0.5) == bool(labels[node]) for node, _ in page.blocks)
    assert right >= 190


def test_main_text_drops_no_element_before_the_model():
    rng = random.Random(10)
    model = html.fitted([html.layout(rng) for _ in range(html.LAYOUT_PAGES)])
    prose = "<p>one two three four five.</p><p>six seven eight nine ten.</p>"
    for tag in ("math", "svg", "object", "video", "canvas", "noscript", "label", "xmp", "audio"):
        assert "E mc" in html.main_text(f"<body><article><h1>T</h1>{prose}<{tag}>E mc</{tag}></article></body>", model), tag
    assert html.main_text("<article><h1>T</h1><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", model) == "T\nso x=2 holds"
    for start in ("<form action=/>", "<label>", "<button>", "<select>"):
        for page in (f"<body>{start}<article><h1>T</h1>{prose}</article></body>", f"<body>{start}<h1>T</h1>{prose}<h2>U</h2>{prose}</body>"):
            assert "one two" in html.main_text(page, model) and "nine ten" in html.main_text(page, model), page
    for open_tag in ("<label>l", "<button>b", "<select><option>o"):
        assert html.main_text(f"<article><h1>T</h1>{prose}{open_tag}<p>the last</p></article>", model).endswith("the last")
    got = html.main_text(f"<article><h1>T</h1>{prose}<script>var q</script><style>q</style><template>q</template><textarea>q</textarea><select><option>q</select></article>", model)
    assert "q" not in got


def plain_nearest(ids, x, query, n=20):
    score = x @ x[query]
    score[query] = -np.inf
    return ids[np.lexsort((ids, -score))[:n]]


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0")).toPandas()
    p = table.toPandas()
    ids, x = p.vec_id.to_numpy(), np.array(p.embedding.tolist(), np.float64)
    asked = np.flatnonzero(ids % 20 == 0)
    hits = sum(len(set(got[got.query_id == ids[q]].vec_id) & set(plain_nearest(ids, x, q))) for q in asked)
    assert hits >= 0.9 * 20 * len(asked)
    assert np.allclose(got.score, [x[ids == a][0] @ x[ids == b][0] for a, b in zip(got.query_id, got.vec_id, strict=True)], rtol=1e-12)


def test_neighbours_lengths_and_copies(spark, monkeypatch):
    """Vectors of very different lengths, a large group of equal ones, blocks of few vectors."""
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    monkeypatch.setattr(neighbours, "CANDIDATES", 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16)) * rng.choice([0.01, 1, 30], size=(2000, 1))
    x[:700] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), 10).toPandas()
    ids = np.arange(2000)
    hits = sum(len(set(got[got.query_id == q].vec_id) & set(plain_nearest(ids, x, q, 10))) for q in range(0, 2000, 50))
    assert hits >= 0.9 * 400


def test_neighbours_odd(spark, rows):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.5, 0.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, score string")
    got = rows(neighbours.nearest(df, df))
    assert got == sorted([(0, 1, 1, 1.0), (0, 2, 7, 0.5), (1, 1, 0, 1.0), (1, 2, 7, 0.5), (7, 1, 0, 0.5), (7, 2, 1, 0.5)], key=repr)
    assert rows(neighbours.nearest(df.limit(0), df)) == [] and rows(neighbours.nearest(df, df.limit(0))) == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert name == "mixture" or docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "benchmark_passages", "personal_data", "mixture"])
def test_pipeline_stage_odd(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "one two three four five six seven"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text + " ", None, None, None), (3, None, None, None, None), (4, "", "en", "b", 0), (None, text, "en", "a", 3), (None, None, None, None, None)]
    got = stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    ids = sorted((r["doc_id"] for r in got), key=repr)
    if name == "near_duplicates":
        assert ids == [1, 3, 4, None]  # the copy without doc_id goes as well
    elif name in ("benchmark_passages", "personal_data"):
        assert ids == [1, 1, 2, 3, 4, None, None]
    assert stage(spark, spark.createDataFrame([], schema), SF).collect() == []


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (1, " ".join(f"b{i}" for i in range(60))), (None, " ".join(f"b{i}" for i in range(60))), (None, "short"), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("kept"))
    got = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    assert sorted(r["text"].split()[0] for r in got) == ["a0", "b0", "short"] and {r["row_key"] for r in got} == {"kept"}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leaked = df.union(spark.createDataFrame([(1, f"x {item} y", "kept"), (None, f"x {item} z", "kept")], df.schema))
    assert corpus_pipeline.benchmark_passages(spark, leaked, SF).count() == 5


def test_quality_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("quality_score", F.lit(7))
    assert corpus_pipeline.quality(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("source", ["<div>" * 200_000, "<div><p>x" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<li>x" * 200_000, "<span><p>" * 100_000])
def test_deep_pages_are_read_in_one_pass(source):
    start = time.process_time()
    html.parsed(source)
    assert time.process_time() - start < 10


@pytest.mark.parametrize("text", ["x" * 1_000_000 + " a@b", "a." * 500_000 + "@", "0123456789abcdef" * 60_000 + "g @", "-+49123456" * 100_000 + " @", "a@" * 500_000])
def test_long_runs_are_searched_once(text):
    start = time.process_time()
    list(surrogates.entities(text))
    assert time.process_time() - start < 10


def test_surrogates_equal_plain_search(spark):
    """What the operator replaces is what a plain search for the same address finds, and equal ones stay equal."""
    rows = [(i, f"write to u{i % 3}@mail{i % 2}.org or 10.0.0.{i % 4}, not x@y") for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in surrogates.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    found = re.compile(r"write to (\S+) or (\S+), not x@y")
    seen = {}
    for i, text in rows:
        old, new = found.fullmatch(text).groups(), found.fullmatch(got[i]).groups()
        for a, b in zip(old, new, strict=True):
            assert a != b and ("@" in a) == ("@" in b) and seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
