"""Mixing sources to target weights by pivotal dependent rounding.

A source that shall give ``r`` times its words gives every document ``floor(r)``
copies and one more with probability ``r - floor(r)``. Those fractions are rounded
in pairs: mass moves from one document to the other, weighted by their sizes so
that the words stay the same, until one of the two is 0 or 1. Each block of
documents leaves one fraction at most, which moves up a tree of blocks; the root of
a source rounds the last one by its probability. Documents of over twice the mean
size go first, and the words by which they miss their share are spread over the
others' fractions. So the words taken differ from the target by less than one
document, as a rule a small one, and each document keeps its expectation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.llm.cuts import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Fractions that one row of the reduction tree pairs up.
BLOCK = 64
_ONE = 1e-9
_UNIT = "struct<doc_id:bigint,size:bigint,x:double>"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources in code point order, null last, take the weights in turn and share all
    words by them, where none exceeds ``cap`` times its own words. Resharing what is
    cut off ends at one level for all sources that are not cut. In order of
    ``cap * size / weight`` the level rises with every source that is cut and falls
    with every other, so it is the largest one.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), number % len(weights) + 1)).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) - before) / others
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return rows.select("source", "source_size", "weight", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _unit(u: Column, x: Column) -> Column:
    return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), x.alias("x"))


def _pair(state: Column, unit: Column, seed: int) -> Column:
    """Move mass between the carried fraction and the next one until one is integral."""
    i, done = state["carry"], state["done"]
    ratio = i["size"] / unit["size"]

    def moved(m: Column) -> Column:
        draw = F.pmod(F.xxhash64(F.lit(seed), i["doc_id"], i["size"], unit["doc_id"], unit["size"], i["x"]), F.lit(1 << 40)) / F.lit(float(1 << 40))
        step = F.when(draw * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"])
        return _let(F.struct((i["x"] + step).alias("a"), (unit["x"] - step * ratio).alias("b")), settled)

    def settled(x: Column) -> Column:
        whole = lambda v: (v < _ONE) | (v > 1 - _ONE)
        a, b = _unit(i, x["a"]), _unit(unit, x["b"])
        return (
            F.when(whole(x["a"]) & whole(x["b"]), F.struct(F.lit(None).cast(_UNIT).alias("carry"), F.concat(done, F.array(a, b)).alias("done")))
            .when(whole(x["a"]), F.struct(b.alias("carry"), F.concat(done, F.array(a)).alias("done")))
            .otherwise(F.struct(a.alias("carry"), F.concat(done, F.array(b)).alias("done")))
        )

    limits = F.struct(
        F.least(1 - i["x"], unit["x"] / ratio).alias("up"), F.least(i["x"], (1 - unit["x"]) / ratio).alias("down")
    )
    return F.when(i.isNull(), F.struct(unit.alias("carry"), done.alias("done"))).otherwise(_let(limits, moved))


def _round_blocks(units: DataFrame, seed: int) -> DataFrame:
    """(source, block, carry, done) of each block of fractions (source, block, doc_id, size, x)."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = F.sort_array(F.collect_list(F.struct("size", order.alias("at"), "doc_id", "x")))
    start = F.struct(F.lit(None).cast(_UNIT).alias("carry"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    rounded = F.aggregate("rows", start, lambda s, u: _pair(s, _unit(u, u["x"]), seed))
    return units.groupBy("source", "block").agg(rows.alias("rows")).select("source", "block", rounded.alias("r")).select("source", "block", "r.*")


def _round_tree(units: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(source, doc_id, size, x) with x rounded, from (source, block, doc_id, size, x); ``blocks`` at most a source."""
    whole = (F.col("x") < _ONE) | (F.col("x") > 1 - _ONE)
    settled = units.where(whole).select("source", "doc_id", "size", "x")
    units = units.where(~whole)
    while True:
        level = cut(_round_blocks(units, seed))
        settled = settled.union(level.select("source", F.explode("done").alias("u")).select("source", "u.*"))
        carried = level.where("carry IS NOT NULL").select("source", "block", "carry.*")
        if blocks <= 1:
            break
        blocks = -(-blocks // BLOCK)
        units = carried.withColumn("block", F.floor(F.col("block") / BLOCK))
    draw = F.pmod(F.xxhash64(F.lit(~seed), "doc_id", "size"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return settled.union(carried.select("source", "doc_id", "size", (draw < F.col("x")).cast("double").alias("x")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of ``docs`` (doc_id, text, source).

    ``size`` is the number of words (null text: 0), ``taken`` is ``copies * size``,
    ``copies`` at most ``cap``. Rows without words take no part in the rounding.
    The draws depend on the seed and the rows alone, so reruns agree. Repeated rows
    are rounded one by one; null sources are one source. Other columns are not
    read. An empty table gives no rows.
    """
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = cut(source_targets(rows, weights, cap))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    counts = rows.where("size > 0").groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    plan = cut(
        targets.join(counts, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("base", F.floor(share + _ONE))
        .select(F.col("source").alias("s"), "source_size", "target", "base", F.greatest(F.lit(0.0), share - F.col("base")).alias("x"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    blocks = F.ceil(F.col("n") / BLOCK)
    most = plan.agg(F.max(blocks)).first()[0] or 0
    joined = rows.join(plan.select("s", "x", blocks.alias("blocks"), (F.col("source_size") / F.col("n")).alias("mean")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    open_ = (F.col("size") > 0) & (F.col("x") >= _ONE)
    settled = joined.where(~open_).select("source", "doc_id", "size", F.lit(0.0).alias("x"))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), "blocks")
    units = cut(joined.where(open_).select("source", block.alias("block"), "doc_id", "size", "x", (F.col("size") > 2 * F.col("mean")).alias("large")))

    large = cut(_round_tree(units.where("large"), most, seed))
    # the words by which the large ones miss their share are made up for by the small ones
    # (sums of whole numbers, which don't depend on the order of the rows)
    expected = units.groupBy(F.col("source").alias("s")).agg(
        (F.sum(F.when(F.col("large"), F.col("size"))) * F.max("x")).alias("wanted"), F.sum(F.when(~F.col("large"), F.col("size"))).alias("room")
    )
    given = large.groupBy(F.col("source").alias("g")).agg(F.sum(F.when(F.round("x") == 1, F.col("size")).otherwise(0)).alias("given"))
    shift = cut(
        expected.join(given, F.col("s").eqNullSafe(F.col("g")), "left")
        .select("s", F.coalesce((F.coalesce("wanted", F.lit(0.0)) - F.coalesce("given", F.lit(0))) / F.col("room"), F.lit(0.0)).alias("shift"))
    )
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("x") + F.col("shift")))
    small = units.where("NOT large").join(shift, F.col("source").eqNullSafe(F.col("s"))).select("source", "block", "doc_id", "size", moved.alias("x"))
    settled = settled.union(large).union(_round_tree(small, most, seed + 1))
    copies = (F.col("base") + F.round("x")).cast("long")
    return settled.join(plan.drop("x", "n"), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
