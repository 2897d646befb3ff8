"""Article feeds in, combined documents out, and CSV to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftmap.functions.text import computed

ARTICLE = "struct<title:string,content:string,status:string,url:string,tags:array<string>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(feed, page, body): one stored response per line."""
    return spark.read.schema("feed string, page long, body string").json(path)


def read_articles(pages: DataFrame, item: str = ARTICLE, field: str = "result") -> DataFrame:
    """Items of paged responses (feed, page, body), up to the first empty page of each feed."""
    parsed = pages.select("feed", "page", F.from_json("body", f"struct<{field}:array<{item}>>")[field].alias("items"))
    ends = (
        parsed.filter(F.coalesce(F.size("items"), F.lit(0)) <= 0)
        .groupBy("feed")
        .agg(F.min("page").alias("end"))
    )
    return (
        parsed.join(ends, "feed", "left")
        .filter(F.col("end").isNull() | (F.col("page") < F.col("end")))
        .select("feed", "page", F.posexplode(computed("items")).alias("pos", "item"))
        .select("feed", "page", "pos", "item.*")
    )


def source_matrix(urls: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, url, request): every URL in every language."""
    return urls.select(F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"), "url").withColumn(
        "request", F.concat("url", F.lit("lang="), "lang")
    )


def export_docs(docs: DataFrame, run_date: str | Column, path: str) -> None:
    """Combined documents as JSON below a folder per run date."""
    day = F.lit(run_date) if isinstance(run_date, str) else run_date
    docs.select("page_content", "metadata", day.alias("run_date")).write.mode("overwrite").partitionBy("run_date").json(path)


def csv_to_json(spark: SparkSession, source: str, target: str, schema: StructType | str) -> None:
    """CSV with a header line to JSON lines; the schema is given, so no pass to infer it."""
    spark.read.csv(source, header=True, schema=schema, escape='"', multiLine=False).write.mode("overwrite").json(target)
