"""Queries of the streams: each runs its stream to the end and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.functions.keywords import steps_named_in
from driftmap.operators import keyed
from driftmap.operators.impact import diagram_profile
from driftmap.plans import derived
from driftmap.plans.oracle import sql
from driftmap.plans.registry import query
from driftmap.session import shared_dir
from driftmap.sources.tree import base_name
from driftmap.streaming import updates as U

#: Files of a batch.
FILES = 4


@query("str1_pushed_changes", sql("""
    SELECT event_id, path, step FROM (
      SELECT DISTINCT event_id, path, step FROM (
        SELECT event_id, event_type || '/' || (CASE event_id % 4 WHEN 0 THEN 'load_split' WHEN 1 THEN 'upload' WHEN 2 THEN 'other' ELSE 'reader' END)
          || (CASE WHEN event_id % 6 = 0 THEN '.md' ELSE '.py' END) AS path FROM events)
      JOIN kw ON contains(string_split(path, '/')[-1], word) WHERE path LIKE '%.py')"""))
def str1(spark, sf):
    base = shared_dir(spark, "pushed")
    e = F.col("event_id")
    name = F.when(e % 4 == 0, "load_split").when(e % 4 == 1, "upload").when(e % 4 == 2, "other").otherwise("reader")
    pushed = derived.table(spark, sf, "events").select(
        "event_id", F.concat("event_type", F.lit("/"), name, F.when(e % 6 == 0, ".md").otherwise(".py")).alias("path")
    )
    pushed.write.parquet(f"{base}/in")

    def step(batch):
        return batch.select("event_id", "path", F.explode(steps_named_in(base_name(F.col("path")))).alias("step"))

    U.stream_updates(spark, f"{base}/in", pushed.schema, f"{base}/out", f"{base}/state", step).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


@query("str2_continuous_ingest", sql("""
    WITH known AS (SELECT d.text, arg_max(v.embedding, v.vec_id) AS embedding FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.doc_id % 2 = 0 GROUP BY d.text)
    SELECT sha256(d.text) AS content_key, d.text AS content, max(d.doc_id) AS doc_id, k.embedding, CASE WHEN k.embedding IS NULL THEN 1 ELSE 0 END AS n_fresh
    FROM documents d LEFT JOIN known k ON k.text = d.text GROUP BY d.text, k.embedding"""))
def str2(spark, sf):
    """Documents arrive in three thirds by id, a batch each, so copies of a text meet across batches."""
    base = shared_dir(spark, "ingest")
    docs = derived.table(spark, sf, "documents").select("doc_id", "text")
    known = docs.filter(F.col("doc_id") % 2 == 0).join(
        derived.table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id")
    )
    U.cache_of(known, "text", "embedding", "vec_id").write.parquet(f"{base}/cache")
    ends = docs.stat.approxQuantile("doc_id", [1 / 3, 2 / 3], 0.01) or [0.0, 0.0]
    third = F.when(F.coalesce(F.col("doc_id") <= ends[0], F.lit(True)), 0).when(F.col("doc_id") <= ends[1], 1).otherwise(2)
    for number in range(3):
        docs.where(third == number).repartition(FILES).write.mode("append").parquet(f"{base}/in")
    U.stream_ingest(
        spark, f"{base}/in", docs.schema, f"{base}/cache", f"{base}/out", f"{base}/state", "text", max_files=FILES, buckets=12
    ).awaitTermination()
    return U.merged_batches(spark, f"{base}/out")


@query("str1_push_decisions", sql("""
    SELECT push_id, diagram_id, node_id, CASE WHEN total = 0 THEN 'full' WHEN pct = 0 THEN 'none' WHEN pct < 20 THEN 'low'
        WHEN pct < 50 THEN 'medium' WHEN pct < 80 THEN 'high' ELSE 'full' END AS impact_level
    FROM (
      SELECT p.change_id AS push_id, p.diagram_id, a.node_id, coalesce(t.total, 0) AS total, CAST(coalesce(c.n, 0) AS DOUBLE) / t.total * 100 AS pct
      FROM (SELECT change_id, diagram_id FROM diff_rows GROUP BY ALL HAVING bool_or(path LIKE '%.py')) p
        LEFT JOIN raw_affected a ON a.change_id = p.change_id
        LEFT JOIN (SELECT change_id, count(*) AS n FROM raw_affected GROUP BY change_id) c ON c.change_id = p.change_id
        LEFT JOIN totals t ON t.diagram_id = p.diagram_id)"""))
def str1_decisions(spark, sf):
    """Each day's diff of a diagram as a push; a third of them is delivered again in a later batch."""
    base = shared_dir(spark, "pushes")
    keyed.create(diagram_profile(derived.diagrams(spark, sf)), f"{base}/profile", "diagram_id", 12)
    pushes = derived.diffs(spark, sf).select(F.col("change_id").alias("push_id"), "diagram_id", "diff_text")
    pushes.repartition(2 * FILES).write.parquet(f"{base}/in")
    spark.read.parquet(f"{base}/in").where(F.crc32("push_id") % 3 == 0).repartition(FILES).write.mode("append").parquet(f"{base}/in")
    U.stream_decisions(spark, f"{base}/in", pushes.schema, f"{base}/profile", f"{base}/out", f"{base}/state", FILES, 12).awaitTermination()
    return U.decided_nodes(keyed.read(spark, f"{base}/out"))
