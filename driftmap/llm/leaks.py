"""Benchmark decontamination: items that are contained in documents.

An item of m distinct shingles is contained at threshold t if a document holds at
least ``ceil(t * m)`` of them, however long the document is. Both sides get MinHash
sketches that are partitioned by size:

* An item's sketch is its ``m - ceil(t * m) + 1`` smallest hash values. A document that
  holds the item lacks fewer shingles than that, so it has one of the values.
* The items of m in [2^p, 2^(p+1)) are partition p. The largest value in a partition's
  sketches is its cutoff, the fewest shingles that one of its items asks for its size.
* A document's sketch is its hash values up to the highest cutoff among the
  partitions that are not too large for the document. No value beyond can meet a
  sketch, so no contained item is missed; the rest is never sent or looked up.

Documents and items whose sketches share a value are verified on the exact shingles.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.llm.cuts import bounded, cut

SEED = 8
#: Bytes of shingles up to which the items' shingles are sent to every executor.
BROADCAST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _runs(rows: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """A row for each run of consecutive ``words`` of one of the lengths: first place, run, hash and text.

    Places are exploded instead of runs, so no array of runs is ever built and
    hashes and texts are made one by one in generated code, where they are used.
    """
    lengths = sorted(lengths)
    n = F.size("words")
    places = F.when(n >= lengths[0], F.sequence(F.lit(0), n - lengths[0])).otherwise(F.array().cast("array<int>"))
    placed = rows.select("*", F.explode(places).alias("place"))
    if len(lengths) == 1:
        placed = placed.withColumn("run", F.lit(lengths[0]))
    else:
        fitting = [F.when(F.col("place") + k <= n, F.lit(k)) for k in lengths]
        placed = placed.select("*", F.explode(F.array(*fitting)).alias("run")).where("run IS NOT NULL")
    value, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    for k in lengths:
        ws = [F.get("words", F.col("place") + j) for j in range(k)]
        value = F.when(F.col("run") == k, F.xxhash64(F.lit(SEED), F.lit(k), *ws)).otherwise(value)
        text = F.when(F.col("run") == k, F.concat_ws(" ", *ws)).otherwise(text)
    return placed.select("*", value.alias("value"), text.alias("shingle"))


def _item_sets(items: DataFrame, k: int) -> DataFrame:
    """(item_id, item_row, place, run, value, shingle): the distinct shingles of each item's row."""
    cleaned = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    cleaned = cleaned.select("item_id", F.xxhash64("text").alias("item_row"), _words(F.col("text")).alias("words"))
    own = _runs(cleaned, range(1, k + 1)).where(F.col("run") == F.least(F.size("words"), F.lit(k)))
    return own.groupBy("item_id", "item_row", "run", "value", "shingle").agg(F.min("place").alias("place"))


def _sketches(sets: DataFrame, percent: int) -> DataFrame:
    """(item_id, item_row, part, least, value): the smallest values of each item."""
    whole = sets.groupBy("item_id", "item_row").agg(F.sort_array(F.collect_set("value")).alias("values"), F.count(F.lit(1)).alias("m"))
    least = F.ceil(F.col("m") * percent / 100 - 1e-9).cast("int")
    whole = whole.select("item_id", "item_row", F.floor(F.log2("m")).cast("int").alias("part"), least.alias("least"), "m", "values")
    probes = F.slice("values", F.lit(1), (F.col("m") - F.col("least") + 1).cast("int"))
    return whole.select("item_id", "item_row", "part", "least", F.explode(probes).alias("value"))


def _cutoff(sketches: DataFrame, n: Column) -> Column:
    """The largest value worth keeping of a document with at most ``n`` shingles, null if no item is small enough."""
    parts = sketches.groupBy("part").agg(F.min("least").alias("least"), F.max("value").alias("value")).orderBy("least").collect()  # one row for each power of two
    limit, highest = F.lit(None).cast("long"), None
    for part in parts:
        highest = part["value"] if highest is None else max(highest, part["value"])
        limit = F.when(n >= part["least"], F.lit(highest)).otherwise(limit)
    return limit


def _sendable(sets: DataFrame) -> DataFrame:
    """The items' shingles, marked for broadcast only if rows and bytes are counted to be few."""
    size = sets.agg(F.sum(F.octet_length("shingle"))).first()[0] or 0
    return bounded(sets) if size <= BROADCAST_BYTES else sets


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of each contained item.

    ``docs`` has doc_id and text, ``items`` item_id and text. Words are lower-cased
    and cut at white space; shingles are distinct runs of ``k`` words. An item of
    fewer words is one shingle, all its words, and is contained wherever they stand
    in a row. Texts that are null or without words contain nothing and are contained
    nowhere. Rows without id are left out. Every row is judged by itself; of rows that
    share ids a pair comes once, with its largest containment. Other columns are not
    read. An empty table on either side gives no rows.
    """
    percent = round(threshold * 100)
    sets = cut(_item_sets(items, k))
    sketches = cut(_sketches(sets, percent))
    lengths = [r[0] for r in sets.select("run").distinct().collect()] or [k]  # 1 to k at most

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("doc_row"), "text")
    read = lambda rows: _runs(rows.select("doc_id", "doc_row", _words(F.col("text")).alias("words")), lengths)
    n = F.size("words") - (min(lengths) - 1)
    sketched = read(texts).where(F.col("value") <= _cutoff(sketches, n)).select("doc_id", "doc_row", "value")
    found = cut(sketched.join(bounded(sketches), "value").select("doc_id", "doc_row", "item_id", "item_row").distinct())

    leaky = found.select("doc_id", "doc_row").distinct()
    held = read(texts.join(bounded(leaky), ["doc_id", "doc_row"], "left_semi")).select("doc_id", "doc_row", "run", "value", "shingle")
    m = sets.groupBy("item_id", "item_row").agg(F.count(F.lit(1)).alias("m"))
    shared = (
        held.join(_sendable(sets), ["run", "value", "shingle"])
        .join(bounded(found), ["doc_id", "doc_row", "item_id", "item_row"], "left_semi")
        .groupBy("doc_id", "doc_row", "item_id", "item_row").agg(F.count_distinct("place").alias("n_shared"))
        .join(bounded(m), ["item_id", "item_row"]).where(F.col("n_shared") * 100 >= F.col("m") * percent)
    )
    best = F.max(F.struct((F.col("n_shared") / F.col("m")).alias("containment"), "n_shared", F.col("m").alias("n_item_shingles"))).alias("best")
    return shared.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item_shingles", "best.n_shared", "best.containment")


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, w, least(len(w), 5) AS k
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
es AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda n: array_to_string(w[n:n + k - 1], ' '))) AS s FROM i),
l AS (SELECT DISTINCT k FROM es),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda n: array_to_string(w[n:n + k - 1], ' '))) AS s FROM d, l),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM es GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN es USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared::DOUBLE / n_item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE n_shared * 100 >= n_item_shingles * 80
"""
