"""Approximate nearest neighbours by a permutation index.

Vectors are represented by the order of their nearest pivots. They lie in blocks of
similar length; a block has its own pivots and, for each, an inverted file that
posts the place of the pivot in the order of every vector. A query is ranked against
a block by the footrule distance of the two orders, the first ``CANDIDATES`` (and all
that are equally far) are scored exactly, and the best of all blocks are its answer.

Large inner products are near directions only among vectors of one length, so each
block adds one coordinate that makes its vectors equally long, and queries have 0
there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmap.llm.cuts import cut

BLOCK = 8192
PIVOTS = 256
#: Places of pivots are posted in steps of so many.
STEP = 4
CANDIDATES = 820
NEAREST = 20
#: Queries that all workers hold at a time.
QUERIES = 32_768


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm): vectors as doubles that are not null or zero and have only finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return (
        vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(finite & F.exists("v", lambda x: x != 0)).withColumn("norm", norm)
    )


def _orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of each pivot (rows) in the order of nearest pivots of each vector (columns), in steps."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    places = np.empty(order.shape, np.int8)
    np.put_along_axis(places, order, np.broadcast_to((np.arange(order.shape[1]) // STEP).astype(np.int8), order.shape), axis=1)
    return np.ascontiguousarray(places.T)


def _footrule(files: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Summed differences of places; a step holds few pivots, so sums of four fit a byte."""
    apart = np.abs(files - places[:, None]).view(np.uint8)
    while len(apart) > PIVOTS // 4 and len(apart) % 2 == 0:
        apart = apart[: len(apart) // 2] + apart[len(apart) // 2 :]
    return apart.sum(axis=0, dtype=np.uint16 if len(apart) <= 64 else np.uint32)


def indexed(vectors: DataFrame) -> DataFrame:
    """One row for each block: ids, vectors, pivots and inverted files as bytes."""
    blocks = max(1, -(-vectors.count() // BLOCK))
    # equal lengths are told apart by a hash, so that no length fills a block beyond its size
    ranged = vectors.repartitionByRange(blocks, "norm", F.xxhash64("vec_id")).withColumn("block", F.spark_partition_id())

    def build(batches):
        ids, rows = [], []
        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            lists = batch.column("v")
            rows += [np.asarray(r, np.float64) for r in lists.to_pylist()]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        for width in sorted({len(r) for r in rows}):
            of = np.array([len(r) == width for r in rows])
            for at in np.array_split(np.flatnonzero(of), -(-of.sum() // BLOCK)):
                own = ids[at]
                x = np.stack([rows[i] for i in at])
                at = np.argsort(own, kind="stable")
                own, x = own[at], x[at]
                square = np.sum(x * x, axis=1)
                longer = np.column_stack([x, np.sqrt(np.maximum(0, square.max() - square))])
                drawn = np.random.default_rng(1).permutation(len(x))[:PIVOTS]
                pivots = longer[np.sort(drawn)]
                pivots = pivots / np.linalg.norm(pivots, axis=1)[:, None]
                yield pa.RecordBatch.from_arrays([
                    pa.array([width], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (own.astype(np.int64), x, pivots, _orders(longer, pivots)))
                ], names=["width", "ids", "vectors", "pivots", "files"])

    return cut(ranged.select("vec_id", "v").mapInArrow(build, "width int, ids binary, vectors binary, pivots binary, files binary"))


def nearest(vectors: DataFrame, queries: DataFrame, n: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``n`` nearest found of each query, other than itself.

    Both sides have vec_id and embedding. The score is the inner product of the
    original vectors in double precision; ties go to the smaller vec_id. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do rows
    without vec_id; only vectors of the query's width are its candidates. Repeated
    rows of a query give its answer once; repeated candidates count as often as they
    come. Other columns are not read. An empty table gives no rows.

    Queries are taken in batches of bounded size that all workers hold; each batch
    reads the index once.
    """
    spark = vectors.sparkSession
    index = indexed(cut(usable(vectors)))
    asked = cut(usable(queries).dropDuplicates(["vec_id"]))
    total = asked.count()
    batches_ = max(1, -(-total // QUERIES))
    found = []
    for i in range(batches_):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches_)) == i).select("vec_id", "v").toArrow()
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lists = [np.asarray(r, np.float64) for r in rows["v"].to_pylist()]
        ids = rows["vec_id"].to_numpy()
        for width in {len(r) for r in lists}:
            of = [j for j, r in enumerate(lists) if len(r) == width]
            by_width[width] = (ids[of], np.stack([lists[j] for j in of]))
        held = spark.sparkContext.broadcast(by_width)

        def search(blocks, held=held):
            for block in blocks:
                for width, *parts in zip(*(block.column(c).to_pylist() for c in block.schema.names), strict=True):
                    if width not in held.value:
                        continue
                    query_ids, q = held.value[width]
                    ids = np.frombuffer(parts[0], np.int64)
                    x, pivots = np.frombuffer(parts[1]).reshape(len(ids), width), np.frombuffer(parts[2]).reshape(-1, width + 1)
                    files = np.frombuffer(parts[3], np.int8).reshape(len(pivots), len(ids))
                    places = _orders(np.column_stack([q, np.zeros(len(q))]), pivots)
                    out = []
                    for j, query in enumerate(query_ids):
                        if len(ids) > CANDIDATES:
                            far = _footrule(files, places[:, j])
                            near = np.flatnonzero(far <= np.partition(far, CANDIDATES - 1)[CANDIDATES - 1])
                        else:
                            near = np.arange(len(ids))
                        near = near[ids[near] != query]
                        score = np.einsum("ij,j->i", x[near], q[j])
                        best = np.lexsort((ids[near], -score))[:n]
                        out.append((np.full(len(best), query), ids[near][best], score[best]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        found.append(cut(index.mapInArrow(search, "query_id long, vec_id long, score double")))
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")
