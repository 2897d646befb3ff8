"""Tables by key, published versions and the streams that use them."""

import pytest
from pyspark.sql import functions as F

from driftmap.operators import ingest as G
from driftmap.operators import keyed
from driftmap.operators.impact import diagram_profile
from driftmap.plans import derived
from driftmap.sources import store
from driftmap.streaming import updates as U

SF = "/root/testdata/sf0.001"


def files_of(m, base):
    import pathlib

    return {b: sorted((p.name, p.stat().st_mtime_ns) for p in pathlib.Path(base, f).iterdir()) for b, f in m.folders.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


CHANGES = "k long, at long, v string, op string"


def test_merge_into_equals_merge(spark, rows, tmp_path):
    base = str(tmp_path)
    target = table(spark, [(i, f"v{i}") for i in range(200)] + [(None, "null key")])
    changes = spark.createDataFrame(
        [(3, 1, "x", "upsert"), (3, 2, "y", "upsert"), (4, 1, None, "delete"), (500, 1, "n", "upsert"), (501, 1, "n", "upsert"), (501, 2, None, "delete"), (5, 3, None, "upsert")], CHANGES
    )
    first = keyed.create(target, base, "k", 32)
    assert keyed.create(target.limit(1), base, "k", 8) == first
    before = files_of(first, base)
    after = G.merge_into(spark, base, changes, ["v"], ["at"], ("s", 0))
    want = rows(G.merge(target.where("k IS NOT NULL"), changes, "k", ["v"], ["at"])) + [(None, "null key")]
    assert rows(keyed.read(spark, base)) == sorted(want, key=repr)
    # untouched buckets keep their folder and files, touched ones have new folders
    hit = {str(b) for b in keyed.touched(changes, first)}
    assert {b for b in after.folders if after.folders[b] != first.folders.get(b)} <= hit
    assert all(files_of(after, base)[b] == before[b] for b in before if b not in hit)
    assert len(hit) < len(first.folders)
    # the batch again: nothing happens
    assert G.merge_into(spark, base, changes, ["v"], ["at"], ("s", 0)) == after
    # readers of the older manifest still have their rows
    assert keyed.read(spark, base, at=first).count() == 201


def test_bucket_without_rows_and_null_key(spark, rows, tmp_path):
    base = str(tmp_path)
    keyed.create(table(spark, []), base, "k", 4)
    assert rows(keyed.read(spark, base)) == []
    change = spark.createDataFrame([(None, 1, "a", "upsert"), (1, 1, "b", "upsert")], CHANGES)
    G.merge_into(spark, base, change, ["v"], ["at"])
    assert rows(keyed.read(spark, base)) == sorted([(None, "a"), (1, "b")], key=repr)
    m = G.merge_into(spark, base, change.withColumn("op", F.lit("delete")), ["v"], ["at"])
    assert m.folders == {} and rows(keyed.read(spark, base)) == []
    m = G.merge_into(spark, base, change.limit(0), ["v"], ["at"], ("s", 7))
    assert m.marks == {"s": 7}


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    stale = keyed.create(table(spark, [(1, "a")]), base, "k", 4)
    change = spark.createDataFrame([(1, 1, "b", "upsert")], CHANGES)
    G.merge_into(spark, base, change, ["v"], ["at"])
    with monkeypatch.context() as m:
        m.setattr(keyed, "manifest", lambda *_: stale)
        with pytest.raises(store.Conflict):
            G.merge_into(spark, base, change.withColumn("v", F.lit("c")), ["v"], ["at"])
    assert keyed.read(spark, base).collect()[0]["v"] == "b"


def test_retire_keeps_what_is_read(spark, tmp_path):
    base = str(tmp_path)
    first = keyed.create(table(spark, [(i, "a") for i in range(20)]), base, "k", 4)
    change = spark.createDataFrame([(1, 1, "b", "upsert")], CHANGES)
    now = G.merge_into(spark, base, change, ["v"], ["at"])
    assert keyed.retire(spark, base, 3_600) == []
    assert keyed.read(spark, base, at=first).count() == 20
    gone = keyed.retire(spark, base, 0)
    assert all(g.startswith("staged/") or f"data/{g}" not in str(now.folders) for g in gone)
    assert keyed.read(spark, base).count() == 20


def test_publish_is_won_by_one(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    G.publish(spark.range(3), base, "docs", "v1")
    before = store.latest(spark, f"{base}/pointers/docs")
    G.publish(spark.range(5), base, "docs", "v2")
    with monkeypatch.context() as m:
        m.setattr(store, "latest", lambda *_: before)
        with pytest.raises(store.Conflict):
            G.publish(spark.range(7), base, "docs", "v3")
    assert G.current_version(spark, base, "docs").count() == 5
    folders = set(store.entries(spark, f"{base}/versions/docs"))
    live = store.latest(spark, f"{base}/pointers/docs")[1]["folder"].rpartition("/")[2]
    G.publish(spark.range(9), base, "docs", "v2")  # a retry of the live version writes nothing
    assert set(store.entries(spark, f"{base}/versions/docs")) == folders and G.current_version(spark, base, "docs").count() == 5
    assert G.retire(spark, base, "docs", 3_600) == []
    held = G.current_version(spark, base, "docs")
    G.publish(spark.range(11), base, "docs", "v4")
    gone = G.retire(spark, base, "docs", 0)
    assert live in gone and len(gone) == 3 and G.current_version(spark, base, "docs").count() == 11
    assert held is not None


def test_create_once(spark, tmp_path):
    path = f"{tmp_path}/a/x"
    assert store.create_once(spark, path, "é") and not store.create_once(spark, path, "b") and store.text_of(spark, path) == "é"
    assert store.entries(spark, f"{tmp_path}/none") == {} and store.latest(spark, f"{tmp_path}/none") is None


def test_copies_over_ten_batches(spark, tmp_path):
    base = str(tmp_path)
    known = spark.createDataFrame([(9, "known", [1.0])], "doc_id long, text string, embedding array<float>")
    U.cache_of(known, "text", "embedding", "doc_id").write.parquet(f"{base}/cache")
    replaced = []
    for n in range(10):
        part = spark.createDataFrame([(100 * n, "same"), (100 * n + 1, f"only {n}"), (100 * n + 1, f"only {n}"), (None, "known")], "doc_id long, text string")
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        before = keyed.manifest(spark, f"{base}/out/state")
        U.stream_ingest(spark, f"{base}/in", part.schema, f"{base}/cache", f"{base}/out", f"{base}/st", "text", 1, 24).awaitTermination()
        after = keyed.manifest(spark, f"{base}/out/state")
        if before:
            replaced.append(sum(before.folders.get(b) != f for b, f in after.folders.items()))
    # a batch of three contents reads and replaces three buckets at most, however many there were before
    assert max(replaced) <= 3
    got = {r["content"]: (r["doc_id"], r["embedding"], r["n_fresh"]) for r in U.merged_batches(spark, f"{base}/out").collect()}
    assert got == {"same": (900, None, 1), "known": (None, [1.0], 0)} | {f"only {n}": (100 * n + 1, None, 1) for n in range(10)}
    copies = {r["doc_id"]: r["copies"] for r in keyed.read(spark, f"{base}/out/state").where("copies > 1").collect()}
    assert copies == {900: 10, None: 10} | {100 * n + 1: 2 for n in range(10)}
    # the last batch again, as after a lost commit
    U.ingest_batch(spark, part.withColumn("content", F.col("text")), 9, f"{base}/out", f"{base}/st")
    assert keyed.manifest(spark, f"{base}/out/state") == after


def test_pushes_stream_equals_batch(spark, rows, tmp_path):
    base = str(tmp_path)
    profile = diagram_profile(derived.diagrams(spark, SF))
    keyed.create(profile, f"{base}/profile", "diagram_id", 8)
    pushes = derived.diffs(spark, SF).select(F.col("change_id").alias("push_id"), "diagram_id", "diff_text")
    docs_only = spark.createDataFrame([("p", "Brand#11/0", "diff --git a/x.md b/x.md\n+chunk_size = 1"), (None, None, None)], "push_id string, diagram_id string, diff_text string")
    pushes.union(docs_only).repartition(3).write.parquet(f"{base}/in")

    def run():
        U.stream_decisions(spark, f"{base}/in", pushes.schema, f"{base}/profile", f"{base}/out", f"{base}/st", 1, 8).awaitTermination()

    run()
    want = U.push_decisions(pushes, profile)
    assert rows(keyed.read(spark, f"{base}/out")) == rows(want) and want.count() > 0
    done = keyed.manifest(spark, f"{base}/out")
    run()
    assert keyed.manifest(spark, f"{base}/out") == done
    # delivered again: decided already
    pushes.repartition(1).write.mode("append").parquet(f"{base}/in")
    run()
    assert rows(keyed.read(spark, f"{base}/out")) == rows(want)
