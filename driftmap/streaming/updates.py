"""Push-triggered runs and continuous ingestion as file streams.

A batch that is run again after a fault adds nothing: it replaces the folder of its
number, and tables by key note the batches they have taken.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from driftmap.operators import keyed
from driftmap.operators.impact import diff_wants, impact_level, touched, with_diff_facts
from driftmap.operators.ingest import content_key, dedup
from driftmap.sources.tree import CHANGED_EXTENSIONS, filter_ext


def _batch_writer(target: str, step: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def stream_updates(
    spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str,
    step: Callable[[DataFrame], DataFrame], max_files: int = 1_000,
) -> StreamingQuery:
    """Run ``step`` over pushed rows (with ``path``) of changed code files, all that are there now.

    ``step`` is the batch job from changes to affected nodes; only code files
    reach it.
    """
    pushed = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return (
        filter_ext(pushed, CHANGED_EXTENSIONS)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_batch_writer(target, step))
        .start()
    )


def push_wants(pushes: DataFrame) -> DataFrame:
    """What pushes point at that change a code file; ``pushes`` is (push_id, diagram_id, diff_text).

    A push that comes more than once counts once, as its row with the smallest text.
    """
    once = pushes.groupBy("push_id", "diagram_id").agg(F.min("diff_text").alias("diff_text"))
    facts = with_diff_facts(once.withColumnRenamed("push_id", "change_id"))
    code = F.exists("changed_files", lambda p: reduce(or_, (p.endswith(e) for e in CHANGED_EXTENSIONS)))
    return diff_wants(facts.where(code))


def push_decisions(pushes: DataFrame, profile: DataFrame) -> DataFrame:
    """(decision_id, push_id, diagram_id, touched, total, impact_pct, impact_level): the impact of each push on its diagram."""
    n, total = F.size("touched"), F.col("total")
    pct = F.when(total == 0, 100.0).otherwise(n / total * 100)
    return (
        touched(push_wants(pushes), profile)
        .withColumn("impact_pct", pct)
        .select(
            F.sha2(F.to_json(F.struct("change_id", "diagram_id")), 256).alias("decision_id"), F.col("change_id").alias("push_id"), "diagram_id",
            F.array_sort("touched").alias("touched"), F.col("total").cast("long").alias("total"), "impact_pct",
            impact_level(total, F.col("impact_pct")).alias("impact_level"),
        )
    )


def decided_nodes(decisions: DataFrame) -> DataFrame:
    """(push_id, diagram_id, node_id, impact_level): a row a touched node, and one without node for a push that touches none."""
    return decisions.select("push_id", "diagram_id", F.explode_outer("touched").alias("node_id"), "impact_level")


def stream_decisions(
    spark: SparkSession, source: str, schema: StructType | str, profile: str, target: str, checkpoint: str,
    max_files: int = 1_000, buckets: int = 256,
) -> StreamingQuery:
    """From pushes to affected nodes: decide on all pushes that are there now.

    ``profile`` is a table by diagram (``operators.keyed``) with the rows of
    ``diagram_profile``; a batch reads the buckets of its pushes' diagrams. Decisions are
    a table by push below ``target``: the first one on a push stays, so a push that is
    delivered again and a batch that runs again add nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            diagrams = keyed.manifest(spark, profile)
            near = keyed.read(spark, profile, keyed.touched(batch, diagrams), diagrams)
            found = push_decisions(batch, near)
            if keyed.manifest(spark, target) is None:
                keyed.create(found.limit(0), target, "decision_id", buckets)
            columns = [c for c in found.columns if c != "decision_id"]
            keyed.apply(spark, target, found, lambda was, new: F.when(was.isNull(), F.struct(*[new[c].alias(c) for c in columns])).otherwise(was), (checkpoint, batch_id))
        finally:
            batch.unpersist()

    pushed = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return pushed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def ingest_batch(spark: SparkSession, batch: DataFrame, batch_id: int, target: str, stream: str) -> None:
    """Take a batch of (doc_id, content) into the tables below ``target``; see ``stream_ingest``.

    Of the state only the buckets of the batch's contents are read and replaced. Texts
    of contents that are new go to a folder of the batch. The state is replaced last
    and notes the batch, so a batch that runs again writes the same folder or nothing.
    """
    state = f"{target}/state"
    now = keyed.manifest(spark, state)
    if now.marks.get(stream, -1) >= batch_id:
        return
    staged = f"{target}/staged/batch={batch_id}"
    dedup(batch, ["doc_id"], ["doc_id"]).select("content_key", "content", "doc_id", "copies").write.mode("overwrite").parquet(staged)
    unique = spark.read.parquet(staged)
    buckets = keyed.touched(unique, now)
    seen = keyed.read(spark, state, buckets, now).where("copies > 0").select("content_key")
    unique.join(seen, "content_key", "left_anti").select("content_key", "content").write.mode("overwrite").parquet(f"{target}/contents/batch={batch_id}")
    keyed.apply(
        spark, state, unique.select("content_key", "doc_id", "copies"),
        lambda was, new: F.struct(
            F.coalesce(new["doc_id"], was["doc_id"]).alias("doc_id"), (F.coalesce(was["copies"], F.lit(0)) + new["copies"]).alias("copies"),
            F.coalesce(was["n_fresh"], F.lit(1)).cast("long").alias("n_fresh"), was["embedding"].alias("embedding"),
        ),
        (stream, batch_id), buckets,
    )


def stream_ingest(
    spark: SparkSession, source: str, schema: StructType | str, cache_path: str, target: str, checkpoint: str,
    content: str, max_files: int = 1_000, buckets: int = 256,
) -> StreamingQuery:
    """Continuous ingestion of documents (doc_id and a text column), reusing cached vectors.

    The state is a table by content with the vector, the last doc_id, the number of
    copies, and whether the content was fresh: neither cached nor in an earlier batch, to be
    embedded. It starts from the cache. Choose ``buckets`` so that a batch touches few of them.
    """
    if keyed.manifest(spark, f"{target}/state") is None:
        none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
        cache = spark.read.parquet(cache_path)
        keyed.create(cache.select("content_key", none.alias("doc_id"), zero.alias("copies"), zero.alias("n_fresh"), "embedding"), f"{target}/state", "content_key", buckets)
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return (
        docs.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: ingest_batch(spark, batch.withColumn("content", F.col(content)), batch_id, target, checkpoint))
        .start()
    )


def merged_batches(spark: SparkSession, target: str) -> DataFrame:
    """(content_key, content, doc_id, embedding, n_fresh): the table the batches add up to, one row per content."""
    state = keyed.read(spark, f"{target}/state").where("copies > 0")
    texts = spark.read.parquet(f"{target}/contents").select("content_key", "content")
    return texts.join(state, "content_key").select("content_key", "content", "doc_id", "embedding", "n_fresh")


def cache_of(docs: DataFrame, content: str, embedding: str, order: str) -> DataFrame:
    """(content_key, embedding): one vector per content."""
    return docs.groupBy(content_key(F.col(content)).alias("content_key")).agg(
        F.max_by(embedding, order).alias("embedding")
    )
