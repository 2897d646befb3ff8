"""Document ingestion: unify, filter, split, chunk, de-duplicate, reuse, publish, merge."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.functions.text import html_to_text, is_blank, passes_quality, strip
from driftmap.operators import keyed
from driftmap.sources import store

CHUNK_SIZE = 1_200
CHUNK_OVERLAP = 100


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def exclude(docs: DataFrame, urls: DataFrame, prefix: str = "") -> DataFrame:
    """Documents whose (prefixed) ``url`` is not on the list."""
    listed = urls.select(F.col("url").alias("listed")).distinct()
    return docs.withColumn("listed", F.concat(F.lit(prefix), "url")).join(listed, "listed", "left_anti").drop("listed")


def published(docs: DataFrame, banned: str | None = None) -> DataFrame:
    """Tagged, published documents, optionally without a text in their URL."""
    keep = (F.size("tags") > 0) & (F.col("status") == "published")
    if banned:
        keep = keep & ~F.col("url").contains(banned)
    return docs.filter(keep)


def split_on_key(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(with, without) the key."""
    return docs.filter(F.col(key).isNotNull()), docs.filter(F.col(key).isNull())


def drop_blank(docs: DataFrame, column: str) -> DataFrame:
    return docs.filter(~is_blank(F.col(column)))


def as_document(
    source: DataFrame, content: Column, title: Column, url: Column, category: Column, language: Column
) -> DataFrame:
    """(doc_id, page_content, metadata): one source in the common shape."""
    return source.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        content.alias("page_content"),
        F.struct(
            title.alias("page_title"), url.alias("source"), category.cast("array<string>").alias("category"),
            language.alias("language"),
        ).alias("metadata"),
    )


def lower_tags(tags: Column) -> Column:
    return F.transform(tags, F.lower)


def unify(*sources: DataFrame) -> DataFrame:
    """All sources as one table of documents."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def pages_to_text(pages: DataFrame, underlined: bool = False) -> DataFrame:
    return pages.withColumn("page_content", html_to_text(F.col("html"), underlined))


def split_headings(docs: DataFrame) -> DataFrame:
    """(…, section, section_text): parts that start at a ``#`` or ``##`` line.

    The heading stays on its part and every part keeps its document's columns.
    A document is split inside its own row. Lines between code fences are no
    headings: every second piece between fences gets a mark before its ``#``.
    """
    pieces = F.transform(
        F.split("page_content", r"(?dm)^```"),
        lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"(?dm)^#", "\u0000#")).otherwise(p),
    )
    parts = F.filter(
        F.transform(F.split(F.array_join(pieces, "```"), r"(?dm)(?=^##?(?: |$))"), lambda p: F.replace(strip(p), F.lit("\u0000#"), F.lit("#"))),
        lambda p: p != "",
    )
    return docs.select("*", F.posexplode(parts).alias("section", "section_text")).drop("page_content")


def chunk(docs: DataFrame, column: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(…, chunk_no, content): windows of ``size`` words that share ``overlap`` words.

    No window lies wholly inside the one before it. Words are found, cut and
    joined inside the row, before anything is shuffled.
    """
    words = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    windows = F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, size), " "))
    return (
        docs.withColumn("words", words)
        .select(*[c for c in docs.columns if c != column], F.posexplode(windows).alias("chunk_no", "content"))
        .filter(F.col("content") != "")
    )


def quality(chunks: DataFrame) -> DataFrame:
    return chunks.filter(passes_quality(F.col("content")))


def prefix_title(chunks: DataFrame, title: Column) -> DataFrame:
    return chunks.withColumn("content", F.concat(F.lit("# "), title, F.lit("\n\n"), "content"))


def dedup(chunks: DataFrame, order: list[str], keep: list[str], content: str = "content") -> DataFrame:
    """One row per content: first position, last metadata.

    ``order`` is a total order of the input, ``keep`` the columns taken from
    the last copy. Copies are merged before the shuffle, however many there are.
    """
    pos = F.struct(*order)
    last = F.max_by(F.struct(content, *keep), pos).alias("last")
    return (
        chunks.groupBy(content_key(F.col(content)).alias("content_key"))
        .agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("copies"), last)
        .select("content_key", "first_pos", "copies", "last.*")
    )


def reuse(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the cached vector of the same content, null where there is none."""
    return chunks.join(cache.select("content_key", "embedding"), "content_key", "left")


def to_embed(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with no cached vector."""
    return chunks.join(cache.select("content_key"), "content_key", "left_anti")


def pairs(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Content with its vector, one table for both."""
    return chunks.join(vectors.select("content_key", "embedding"), "content_key")


def embed_counts(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """(total, new): all contents, and those without a cached vector."""
    return (
        chunks.select("content_key")
        .join(cache.select("content_key", F.lit(True).alias("hit")), "content_key", "left")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit").isNull()).alias("new"))
    )


def version_name(*parts: Column, at: Column) -> Column:
    """Name of a versioned target, ending in the run time."""
    return F.concat_ws("-", *parts, F.date_format(at, "yyyy-MM-dd-HH-mm-ss"))


def stale_versions(versions: DataFrame, prefix: Column, current: DataFrame) -> DataFrame:
    """Versions with the prefix that are not a current one."""
    return versions.filter(F.col("version").startswith(prefix)).join(
        current.select("version").distinct(), "version", "left_anti"
    )


def publish(df: DataFrame, base: str, alias: str, version: str) -> DataFrame:
    """Write a version, point the alias at it, and give back the versions to retire (version).

    Every attempt writes a folder of its own, so nothing that a reader may hold is
    written again, and the pointer moves only if it still is where it was when the
    attempt began: of two writers one wins, the other gets a ``Conflict``. Publishing
    the version that is live changes nothing.
    """
    spark, pointers = df.sparkSession, f"{base}/pointers/{alias}"
    was = store.latest(spark, pointers)
    if was is None or was[1]["version"] != version:
        folder = f"versions/{alias}/{uuid.uuid4().hex}"
        df.write.parquet(f"{base}/{folder}")
        store.append(spark, pointers, was[0] if was else -1, {"version": version, "folder": folder})
    others = sorted({p["version"] for _, p, _ in store.numbered(spark, pointers)} - {version})
    return spark.createDataFrame([(v,) for v in others], "version string")


def current_version(spark: SparkSession, base: str, alias: str) -> DataFrame:
    """The published table: the rows that ``alias`` points at now, also as a view of that name."""
    rows = spark.read.parquet(f"{base}/{store.latest(spark, f'{base}/pointers/{alias}')[1]['folder']}")
    rows.createOrReplaceTempView(alias)
    return rows


def retire(spark: SparkSession, base: str, alias: str, grace_seconds: float) -> list[str]:
    """Remove folders that ``alias`` hasn't pointed at for ``grace_seconds``, lost attempts included; their names.

    Time is counted up to the last swap, which readers of the live version have seen.
    """
    history = store.numbered(spark, f"{base}/pointers/{alias}")
    now = history[-1][2] if history else 0
    ends = [at for _, _, at in history[1:]] + [None]
    held = {p["folder"].rpartition("/")[2] for (_, p, _), end in zip(history, ends, strict=True) if end is None or now - end < grace_seconds * 1000}
    gone = [n for n, at in sorted(store.entries(spark, f"{base}/versions/{alias}").items()) if n not in held and now - at >= grace_seconds * 1000]
    for name in gone:
        store.remove(spark, f"{base}/versions/{alias}/{name}")
    return gone


def merge(target: DataFrame, changes: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Target after the latest change of each key: delete, update or insert.

    ``changes`` has the key, the columns, the order columns and ``op``.
    """
    latest = changes.groupBy(key).agg(F.max_by(F.struct("op", *columns), F.struct(*order)).alias("c"))
    was = target.select(key, F.struct(*columns).alias("t"), F.lit(True).alias("had"))
    return (
        was.join(latest, key, "full_outer")
        .filter(F.col("c.op").isNull() | (F.col("c.op") != "delete"))
        .withColumn("row", F.when(F.col("c").isNotNull(), F.struct(*[F.col(f"c.{x}").alias(x) for x in columns])).otherwise(F.col("t")))
        .select(key, "row.*")
    )


def merge_into(
    spark: SparkSession, base: str, changes: DataFrame, columns: list[str], order: list[str], mark: tuple[str, int] | None = None
) -> keyed.Manifest:
    """``merge`` into a table laid out by key (``keyed.create``): only the buckets of changed keys are rewritten.

    ``changes`` has the key, the columns, the order columns and ``op``. Changes are
    reduced to the latest of each key before they meet the table.
    """
    key = keyed.manifest(spark, base).key
    latest = changes.groupBy(key).agg(F.max_by(F.struct("op", *columns), F.struct(*order)).alias("c")).select(key, "c.*")
    return keyed.apply(
        spark, base, latest, lambda was, new: F.when(new["op"] != "delete", F.struct(*[new[c].alias(c) for c in columns])), mark
    )


def preprocess(records: DataFrame, key: Column, order: list[str], columns: list[str]) -> DataFrame:
    """One record per normalised key: the first in the given order."""
    return (
        records.groupBy(key.alias("record_key"))
        .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
        .select("record_key", "r.*")
    )


def normalised(c: Column) -> Column:
    """Lower case, single blanks, no ends."""
    return strip(F.regexp_replace(F.lower(c), r"\s+", " "))
