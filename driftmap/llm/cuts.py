"""Cutting lineage in the folder that all machines of the cluster share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.session import checkpoint_root


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept below ``spark.checkpoint.dir`` and read from there.

    An executor that is lost later costs a read, not the work above the cut.
    Spark removes the files when the returned DataFrame is no longer in use and
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


#: Rows of the smaller side up to which a join sends it to every executor; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if it is counted to have few rows.

    Meant for a cut table of ids or other short values, which is cheap to count.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the given tables; only these are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node it can reach.

    Smallest labels move along the edges and then each label is replaced by the
    label of the node it names, so a chain needs about the logarithm of its length
    in rounds. Rounds are cut, and only their number of changes reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = moved.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = cut(moved.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where(~F.col("label").eqNullSafe(F.col("old"))).limit(1).count() == 0:
            return labels
