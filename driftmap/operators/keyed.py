"""Tables by key in hash buckets, of which a change rewrites only those it touches.

Rows lie in one folder a bucket. A manifest names the folder of every bucket;
changing the table writes new folders for the touched buckets and then the next
manifest, which fails if another writer was first. Folders of untouched buckets stay
in use as they are, and readers of an older manifest keep theirs. A manifest
can carry the number of the last batch of a stream, so a batch that runs again is
seen to be done.

A bucket is read and rewritten whole: choose ``buckets`` so that one holds few rows,
and lay the table out anew with more of them when it has grown.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftmap.sources import store


@dataclass(frozen=True)
class Manifest:
    """``folders`` maps a bucket (as text) to its folder below the table; a bucket without rows has none."""

    number: int
    key: str
    buckets: int
    schema: str
    folders: dict[str, str]
    marks: dict[str, int]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, base: str) -> Manifest | None:
    """The table as it is now; None if there is none."""
    found = store.latest(spark, f"{base}/manifest")
    return Manifest(number=found[0], **found[1]) if found else None


def _commit(spark: SparkSession, base: str, after: Manifest) -> Manifest:
    content = asdict(after)
    number = content.pop("number")
    store.append(spark, f"{base}/manifest", number - 1, content)
    return after


def _written(rows: DataFrame, base: str) -> dict[str, str]:
    """Write rows with their bucket, and give the folder of each bucket that has rows."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{base}/{folder}")
    names = [n for n in store.entries(spark, f"{base}/{folder}") if n.startswith("__bucket=")]
    return {n.removeprefix("__bucket="): f"{folder}/{n}" for n in names}


def create(rows: DataFrame, base: str, key: str, buckets: int) -> Manifest:
    """Lay out a new table from rows with one row a key; a table that exists stays as it is."""
    spark = rows.sparkSession
    there = manifest(spark, base)
    if there:
        return there
    folders = _written(rows.withColumn("__bucket", bucket_of(key, buckets)), base)
    return _commit(spark, base, Manifest(0, key, buckets, rows.schema.json(), folders, {}))


def read(spark: SparkSession, base: str, only: list[int] | None = None, at: Manifest | None = None) -> DataFrame:
    """The table, or some of its buckets; only their folders are read."""
    m = at or manifest(spark, base)
    schema = StructType.fromJson(json.loads(m.schema))
    paths = [f"{base}/{f}" for b, f in m.folders.items() if only is None or int(b) in set(only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched(rows: DataFrame, m: Manifest) -> list[int]:
    """The buckets that keys of ``rows`` fall into; at most as many as the table has."""
    return sorted(r["b"] for r in rows.select(bucket_of(m.key, m.buckets).alias("b")).distinct().collect())


def apply(
    spark: SparkSession, base: str, changes: DataFrame, combine: Callable[[Column, Column], Column], mark: tuple[str, int] | None = None,
    buckets: list[int] | None = None,
) -> Manifest:
    """Change the table by rows with one row a key, and give the manifest that holds now.

    ``combine`` gets a key's row of the table and its row of the changes as structs (the
    one or the other may be null) and gives the row to keep as a struct of the table's columns
    without the key; null removes the key. A null key is a key. With a ``mark``
    (stream, batch), a batch that the table has already taken changes nothing.

    Changes are first written, as they are read twice; give ``buckets`` (of ``touched``)
    if they are a stored table already.
    """
    m = manifest(spark, base)
    if mark and m.marks.get(mark[0], -1) >= mark[1]:
        return m
    if buckets is None:
        staged = f"{base}/staged/{uuid.uuid4().hex}"
        changes.write.parquet(staged)
        changes = spark.read.parquet(staged)
        buckets = touched(changes, m)
    old = read(spark, base, buckets, m)
    fields = [c for c in old.columns if c != m.key]
    new = changes.select(m.key, F.lit(None).cast(_struct(old, fields)).alias("was"), F.struct(*[c for c in changes.columns if c != m.key]).alias("new"))
    was = old.select(m.key, F.struct(*fields).alias("was"), F.lit(None).cast(new.schema["new"].dataType).alias("new"))
    both = was.unionByName(new).withColumn("__bucket", bucket_of(m.key, m.buckets)).repartition("__bucket")
    # at most one row of each kind, so any of them is the one; rows of a bucket stay in their partition
    kept = (
        both.groupBy("__bucket", m.key).agg(F.first("was", ignorenulls=True).alias("was"), F.first("new", ignorenulls=True).alias("new"))
        .select("__bucket", m.key, F.when(F.col("new").isNull(), F.col("was")).otherwise(combine(F.col("was"), F.col("new"))).alias("row"))
        .where("row IS NOT NULL").select(m.key, "row.*", "__bucket").select(*old.columns, "__bucket")
    )
    folders = {b: f for b, f in m.folders.items() if int(b) not in set(buckets)} | _written(kept, base)
    marks = m.marks | ({mark[0]: mark[1]} if mark else {})
    return _commit(spark, base, replace(m, number=m.number + 1, folders=folders, marks=marks))


def _struct(rows: DataFrame, fields: list[str]) -> StructType:
    return StructType([rows.schema[f] for f in fields])


def retire(spark: SparkSession, base: str, grace_seconds: float) -> list[str]:
    """Remove the folders that no manifest of the last ``grace_seconds`` names, staged changes included."""
    history = store.numbered(spark, f"{base}/manifest")
    now = max(store.entries(spark, f"{base}/manifest").values(), default=0)
    # a manifest was current until the next one was written
    ends = [at for _, _, at in history[1:]] + [None]
    live = {f.split("/")[1] for (_, m, _), end in zip(history, ends, strict=True) if end is None or now - end < grace_seconds * 1000 for f in m["folders"].values()}
    gone = []
    for kind in ("data", "staged"):
        for name, at in store.entries(spark, f"{base}/{kind}").items():
            if name not in live and now - at >= grace_seconds * 1000:
                store.remove(spark, f"{base}/{kind}/{name}")
                gone.append(f"{kind}/{name}")
    return gone
