"""Statement, comment and setting rows of literal sources."""

from pyspark.sql import functions as F

from driftmap.operators import facts as A
from driftmap.plans import derived

TRAPS = '''# STEP 1 read
# TODO later
x = 5
# why x
run(inner(x), key=inner(2))
if check(x):
    y = Thing(a, chunk_size=3, **more)
elif x:
    for i in range(3):
        print("loop", i)
        print(i)
else:
    z: int = made(1)
    z += added(2)
@wrapped(1)
def f(a=default(0)):
    return [g(n) for n in a]
async def h():
    await waited()
w = {"a": 1, **x}
s = "short"
t = "''' + "t" * 100 + '''"
q = other(1)
log.info(x)
Catalog(1, "text")
'''


def parse(spark, **sources):
    files = spark.createDataFrame([("r", p, c) for p, c in sources.items()], "repo_id string, path string, content string")
    return A.parse_files(files)


def test_statement_rows(spark):
    got = [r["text"] for r in A.statement_facts(parse(spark, a=TRAPS)).orderBy("seq").collect()]
    assert got == [
        None,
        "ACTION: run(inner(x))",
        "IF CHECK: check(x)",
        "  ACTION: check(x)",
        "  CONFIG: y = Thing(a, chunk_size=3, None=more)",
        "  IF CHECK: x",
        "    ACTION: range(3)",
        '    LOG_EVENT: "loop"',
        None,
        "    ACTION: made(1)",
        "    ACTION: added(2)",
        "DEF FUNCTION f:",
        "  ACTION: default(0)",
        "  ACTION: g(n)",
        "  ACTION: wrapped(1)",
        "ACTION: waited()",
        "DATA_STRUCT: w = Keys['a']",
        'CONSTANT: s = "short"',
        'CONSTANT: t = "' + "t" * 100 + '"',
        "ASSIGN: q = CALL other(1)",
        None,
        'LOG_EVENT: "1"',
    ]


def test_comments_attach_by_line(spark):
    got = [
        (r["seq"], r["line"], r["comment_line"])
        for r in A.attach_comments(parse(spark, a=TRAPS)).orderBy("seq", "comment_line").collect()
    ]
    # The to-do comment never attaches; a call does not close the reach of a comment.
    assert got == [(0, 3, 1), (1, 5, 4), (2, 6, 4), (3, 6, 4)][: len(got)] and got[:3] == [(0, 3, 1), (1, 5, 4), (2, 6, 4)]


def test_one_comment_for_several_calls(spark):
    got = A.attach_comments(parse(spark, a="# c\nf()\ng()\nx = 1\nh()\n"))
    assert sorted((r["seq"], r["comment_line"]) for r in got.collect()) == [(0, 1), (1, 1)]


def test_faults_are_rows(spark):
    p = parse(spark, bad="def f(:", good="a = 1", none=None)
    assert sorted(r["path"] for r in A.fact_errors(p).collect()) == ["bad", "none"]
    told = {r["path"]: r["skeleton"] for r in A.render_skeleton(p).collect()}
    assert told["good"] == "" and told["bad"].startswith("Error parsing script: ")


def test_rendered_comment_forms(spark):
    long = "w" * 160
    source = f"# == Part ==\na = f(1)\n# STEP two\nb = f(2)\n# {long}\nc = f(3)\n# plain\nd = f(4)\n"
    told = A.render_skeleton(parse(spark, a=source)).first()["skeleton"]
    rule = "=" * 70
    assert told == "\n".join([
        f"\n{rule}\n== Part ==\n{rule}", "ASSIGN: a = CALL f(1)", "\n>>> STEP two", "ASSIGN: b = CALL f(2)",
        "  ## " + long, "ASSIGN: c = CALL f(3)", "  # plain", "ASSIGN: d = CALL f(4)",
    ])
    cut = A.render_skeleton(parse(spark, a=source), comment_chars=150).first()["skeleton"]
    assert cut == told.replace(long, "w" * 150 + "...")
    plain = A.render_skeleton(parse(spark, a=source), include_comments=False).first()["skeleton"]
    assert plain == "\n".join(f"ASSIGN: {v} = CALL f({i})" for i, v in enumerate("abcd", 1))


def test_comment_classes(spark):
    texts = {"STEP 1": "step_marker", "TODO x": "todo", "fixme y": "todo", "===== A": "section_header", "- b": "section_header",
             "w" * 120: "docstring", "x": "explanation", "next step here": "step_marker"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", A.comment_class(F.col("t")).alias("k")).collect()} == texts


def test_line_scan_agrees_with_parser(spark, rows):
    source = "a = '#no'  # yes\n## double ##\n#\nb = \"it's # no\"\n  # indented\nc = 'x\\'# no' # end\n"
    files = spark.createDataFrame([("r", "p", source)], "repo_id string, path string, content string")
    cols = ["line", "text", "type"]
    assert rows(A.comments(files).select(*cols)) == rows(A.parsed_comments(A.parse_files(files)).select(*cols))


def test_config_facts(spark, rows):
    source = 'b = os.getenv("BUCKET")\ne = os.environ["KEY"]\nm = Config.fetch("model-name")\ns = Split(size=10, name="x", r=0.5)\nif a == 3:\n'
    files = spark.createDataFrame([("r", "p", source)], "repo_id string, path string, content string")
    assert rows(A.config_facts(files).select("line", "kind", "key", "value")) == [
        (1, "env", "BUCKET", None), (2, "env", "KEY", None), (3, "fetch", "model-name", None),
        (4, "literal", "name", "x"), (4, "literal", "r", "0.5"), (4, "literal", "size", "10"),
    ]


def test_long_line_comment(spark, rows):
    files = spark.createDataFrame([("r", "min.js", "x = '" + "a" * 200_000 + "' + \"b\" # end"), ("r", "open.py", "it's # no " + "z" * 200_000)], "repo_id string, path string, content string")
    assert rows(A.comments(files).select("path", "text")) == [("min.js", "end")]


def test_plain_comments_equal_tokens():
    from test_sinks_dictionary import SOURCES

    more = [
        "x = 1 \\\n  # c\n", "# é ü\ny = 'ß # no' # ok", "def g():\n    # in\n    return '''\n# no\n''' # z\n\n#end", "s = b'# no' r'\\' # y",
        "v = rb\"\\\"# no\" # w\n", "a.b.c(d.e, (g()).g.h)#t", "if 1:\n\tx = 2 # tab\n# u v\n", "",
    ]
    n = 0
    for source in [*SOURCES, *more]:
        try:
            A.ast.parse(source)
        except SyntaxError:
            continue
        if not A._UNSURE.search(source):
            n += 1
            assert list(A._plain_comments(source)) == list(A._comments(source)), source
    assert n >= len(more)
    for unsure in ("f'{x!r:#>4}'", 'F"{d["a#b"]}" # c', "rf'#'", "fr'#'", "x = 1 # a\r\n"):
        assert A._UNSURE.search(unsure)


def test_sources_of_expressions():
    for text in ("a.b.c", "a.b().c.d", "(a + b).c.d", "(1).real.imag", "a[0].b.c", "'x'.join.y", "(await x).y.z", "(lambda: 1).a.b"):
        node = A.ast.parse(f"async def g():\n    {text}").body[0].body[0].value
        assert A._source(node) == A.ast.unparse(node)


def test_scripts_are_dealt(spark, tmp_path):
    """One file of parts is one task's; the scripts of its rows are not."""
    spark.range(4000).selectExpr(
        "id AS p_partkey", "concat('n', id) AS p_name", "concat('Brand#', id % 9) AS p_brand", "'LARGE' AS p_type", "CAST(id % 50 AS INT) AS p_size"
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (derived.scripts, derived.quoted_scripts):
        plan = made(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(k" in plan
    facts = A.config_facts(derived.scripts(spark, str(tmp_path)))
    assert facts.count() == 5 * sum(k % 97 != 5 for k in range(4000))


def test_sources_of_comparisons_need_no_unparser(monkeypatch):
    texts = ("a > 10", "a.b is not None", "1 <= x < y.z != 'q'", "k not in d", "True == x")
    nodes = [A.ast.parse(text, mode="eval").body for text in (*texts, "u'x' == b", "-1 < x", "x == (y == z)", "f(a) in b", "x < 1.5")]
    assert [A._source(n) for n in nodes] == [A.ast.unparse(n) for n in nodes]
    monkeypatch.setattr(A.ast, "unparse", None)
    assert [A._source(n) for n in nodes[: len(texts)]] == list(texts)


def test_rendering_explodes_no_lines(spark):
    """Statements take comments from a frame of lines: no row is exploded, and files are not grouped by line before."""
    plan = A.render_skeleton(parse(spark, a=TRAPS))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning(repo_id") == 2
    assert "REPARTITION_BY_NUM" in plan, "few bytes of sources must not become few tasks"


def test_copies_of_a_file_share_their_lines(spark):
    source = "# one\na(); b()\nx = 1 # two\nc()\n"
    files = spark.createDataFrame([("r", "p", source)] * 2, "repo_id string, path string, content string")
    got = A.attach_comments(A.parse_files(files)).groupBy("seq", "comment_line").count().collect()
    # an assignment bounds what follows it, a copy of it too: of both copies of x one takes both comments, one none
    assert sorted(map(tuple, got)) == [(0, 1, 4), (1, 1, 4), (2, 1, 2), (2, 3, 2)]
    told = A.render_skeleton(A.parse_files(files)).first()["skeleton"].split("\n")
    assert told == ["  # one"] * 4 + ["ACTION: a()"] * 2 + ["  # one"] * 4 + ["ACTION: b()"] * 2 + ["  # one"] * 2 + ["  # two"] * 2 + ["ACTION: c()"] * 2


def test_collector_waits_for_the_tree():
    """A tree of many nodes is built and read without a pass of the collector, which goes on behind it, faults or not."""
    seen = []
    note = lambda phase, info: seen.append(phase)
    source = "\n".join(f"x{i} = f(a.b, {i}, k=[{i}, g(c)])" for i in range(3000))
    A.gc.callbacks.append(note)
    try:
        told = A._told_by(source)
        during = len(seen)
    finally:
        A.gc.callbacks.remove(note)
    assert len(told) == 3000 and told[7] == (7, 8, 0, "assign", "x7", "f", ["a.b", "7"], ["k=[7, g(c)]"], "call", None)
    assert during == 0 and A.gc.isenabled()
    assert A._file_rows("def f(:")[-1][3] == "error" and A.gc.isenabled()


def test_only_comments_are_read_as_comments(spark):
    plan = A.render_skeleton(parse(spark, a=TRAPS))._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(trim(text#" not in plan and "trim(trim(CASE WHEN (node#" in plan


def test_class_by_the_first_signs(spark):
    texts = {"ß" * 17 + "step": "explanation", "ß" * 8 + "step": "step_marker", "a" * 16 + "step": "step_marker", "a" * 17 + "step": "explanation",
             "ﬁxme": "todo", "\U0001f600" * 16 + "step": "step_marker", None: "explanation"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", A.comment_class(F.col("t")).alias("k")).collect()} == texts


def test_bracket_nodes_of_a_long_word(spark):
    from driftmap.functions.text import count_bracket_nodes

    texts = {"w" * 400_000: 0, "P1[\"a\"] --> P2(b [c])\nÄ1 {d}": 3, "a[x]b[y]": 2, "a(b(c\nd) e< f>": 1, "a.b[c": 0, "1 \t\n[z]": 1, "": 0}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", count_bracket_nodes(F.col("t")).alias("n")).collect()} == texts


def test_rendering_keeps_its_tasks(spark):
    plan = A.render_skeleton(parse(spark, a=TRAPS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_lines_of_diagrams_are_sorted_without_a_comparator(spark):
    plan = derived.diagrams(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_a_leaf_is_one_call():
    """Names, dotted names and constants are most of what a tree is asked for: each takes one call, or two."""
    import sys

    calls = []
    tree = A.ast.parse("x = f(a, b, c)\n" * 100)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        found = []
        A._statements(tree, 0, found)
    finally:
        sys.setprofile(None)
    assert found[99] == (99, 100, 0, "assign", "x", "f", ["a", "b", "c"], [], "call", None)
    assert len(calls) <= 7 * 100


def test_letters_are_raised_and_lowered_once(spark):
    plan = A.render_skeleton(parse(spark, a=TRAPS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("upper(") == 1


def test_blocks_are_searched_for_faults_once(spark, tmp_path):
    from driftmap.plans.fact_queries import context

    spark.createDataFrame(
        [(5, "n", "Brand#1", "LARGE", 3), (6, "m", "Brand#1", "LARGE", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    ).write.parquet(f"{tmp_path}/part.parquet")
    said = "Error parsing script: a: Error parsing script: b\nError parsing script: c"
    spark.createDataFrame([(1, said, "s"), (9, "x = 1", "s"), (2, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    blocks = context(spark, str(tmp_path))
    plan = blocks.groupBy("repo_id").agg(F.sum("block_chars"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2  # for texts and for skeletons
    got = {r["path"]: (r["block"], r["block_chars"]) for r in blocks.collect()}
    assert set(got) == {"src/.cache/f1.js", "src/.cache/f9.py", "src/p5.py", "src/p6.py"}
    block = "\n--- FILE: src/.cache/f1.js ---\nError parsing script\nError parsing script\n"
    assert got["src/.cache/f1.js"] == (block, len(block))
    assert all(len(b) == n for b, n in got.values())
