"""Source trees through the data source."""

import pytest
from pyspark.sql import functions as F

from driftmap.sources import tree as T
from driftmap.sources import tree_format


@pytest.fixture
def tree(spark, tmp_path):
    names = ("main.py", "__main__.py", ".eslintrc.js", "_private/a.py", ".git/hooks/x.py", "src/deep/b.py", "src/c.tar.gz", "Makefile", "e.")
    for repo in ("one", "two"):
        for name in names:
            path = tmp_path / repo / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(f"{repo} {name}")
    (tmp_path / "two" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "beside.py").write_text("no repository")
    tree_format.register(spark)
    return spark.read.format("source_tree").load(str(tmp_path)), tmp_path


def test_equals_the_distributed_scan(spark, rows, tree):
    df, base = tree
    assert rows(df.select("repo_id", "path", "ext", "n_bytes", "content", "readable")) == rows(T.scan_fleet(spark, str(base)).select("repo_id", "path", "ext", "n_bytes", "content", "readable"))


def test_filters_are_pushed(rows, tree):
    df, _ = tree
    some = df.where((F.col("repo_id") == "two") & F.col("path").endswith(".py") & F.col("path").startswith("src/"))
    assert rows(some.select("path", "content")) == [("src/deep/b.py", "two src/deep/b.py")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    # what the source takes over, Spark doesn't test again
    assert "source_tree" in plan and "Filter" not in plan.replace("RuntimeFilters", "")
    assert "Filter" in df.where(F.length("path") > 12)._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert df.where(F.col("repo_id") == "none").count() == 0
    assert df.where(F.col("path").isin("main.py", "x")).count() == 2 and df.where(F.length("path") > 12).count() == 6


def test_reader_lists_only_what_it_may_need(tree):
    _, base = tree
    reader = tree_format.TreeReader(str(base))
    left = list(reader.pushFilters([tree_format.EqualTo(("repo_id",), "one"), tree_format.StringStartsWith(("path",), "src/d"), tree_format.EqualTo(("ext",), ".py")]))
    assert left == [tree_format.EqualTo(("ext",), ".py")]
    assert [p.folders for p in reader.partitions()] == [[("one/src/deep", "b.py", "b.py")]]


def test_a_huge_folder_uses_many_tasks(spark, tmp_path):
    folder = tmp_path / "repo"
    folder.mkdir()
    for i in range(3_000):
        (folder / f"f{i:05d}.py").touch()
    tree_format.register(spark)
    df = spark.read.format("source_tree").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 12 and df.count() == 3_000
    plan = tree_format.TreeReader(str(tmp_path)).partitions()
    assert len(plan) == 12 and plan[0].folders == [("repo", "f00000.py", "f00255.py")]
