"""Clean a corpus: quality, near duplicates, benchmark passages, personal data, mixture.

Every stage takes all documents that the one before kept, is written as Parquet in
the shared folder and read again. Near duplicates and benchmark passages judge a row by
a 64-bit hash of its doc_id and text, so rows without doc_id and different texts under one
doc_id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm.cuts import bounded, cut
from driftmap.llm.jaccard import jaccard_components
from driftmap.llm.leaks import contained_items
from driftmap.llm.mixing import mixed
from driftmap.llm.quality import accepted, scored
from driftmap.llm.queries import SURROGATE_KEY
from driftmap.llm.surrogates import with_surrogates
from driftmap.session import shared_dir

#: DuckDB can express neither the classifier nor the surrogates nor the draws of the mixture.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row in a column of its own; equal rows have equal keys."""
    key = _free(docs, "row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    score = _free(docs, "quality_score")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score).where(accepted(F.col(score))).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest doc_id stays, once; nulls come last."""
    rows, key = _by_row(docs)
    found = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), 5, 80, 100)
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    found = cut(found.where((F.col("component_id") != F.col(key)) | (F.col("n") > 1)).select(key, "component_id"))
    members = cut(found.union(found.select(F.col("component_id").alias(key), "component_id")).distinct())
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first")
    kept = cut(rows.select(key, "doc_id").join(bounded(members), key).groupBy("component_id").agg(first).select(f"first.{key}"))
    single = rows.join(bounded(members.select(key)), key, "left_anti")
    return single.unionByName(rows.join(bounded(kept), key, "left_semi").dropDuplicates([key])).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    rows, key = _by_row(docs)
    found = contained_items(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(bounded(cut(found.select(F.col("doc_id").alias(key)).distinct())), key, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the text."""
    out = with_surrogates(docs, SURROGATE_KEY).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with the number of their copies and the words taken."""
    return mixed(docs).where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data), ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
