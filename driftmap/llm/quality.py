"""Quality classifier: logistic regression over hashed word n-grams.

A text is seen twice: as its words without punctuation around them, lower-cased,
and as their shapes (``Word***`` is ``Aa*``, a word that repeats the one before is
``=``). Single words and pairs of both views are hashed to ``DIMENSIONS`` features,
whose counts are scaled to length 1. Training follows the regularised leader
(per-coordinate steps): every round, a fixed number of shards continues from the
common state, and what they add to it is summed up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.llm.cuts import cut
from driftmap.llm.words import Words, chained, slices, words

DIMENSIONS = 1 << 20
#: About so many labelled rows are learnt from at most, by a hash of their id.
SAMPLE_ROWS = 8_000
SHARDS, ROUNDS = 8, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.5
THRESHOLD = 0.3
#: Text bytes whose features are in a worker's memory at a time.
SLICE_BYTES = 1 << 20

_AROUND = re.compile(r"^\W+|[\W_]+$")
_UPPER, _LOWER, _DIGIT, _AGAIN = re.compile(r"[A-Z]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
_REPEATED = np.uint64(xxhash.xxh3_64_intdigest("=", 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def shape(word: str) -> str:
    """The whole word with runs of capitals, other letters and digits as A, a and 9 and any repeated sign once."""
    return _AGAIN.sub(r"\1", _DIGIT.sub("9", _LOWER.sub("a", _UPPER.sub("A", word))))


def _views(w: Words) -> tuple[np.ndarray, np.ndarray]:
    vocabulary = w.vocabulary.to_pylist()
    plain = (xxhash.xxh3_64_intdigest(_AROUND.sub("", x).lower(), 1) for x in vocabulary)
    shapes = (xxhash.xxh3_64_intdigest(shape(x), 2) for x in vocabulary)
    return np.fromiter(plain, np.uint64, len(vocabulary)), np.fromiter(shapes, np.uint64, len(vocabulary))


def features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of each text and their values; the squares of the values add up to 1."""
    views = [view[w.codes] if len(w.codes) else np.zeros(0, np.uint64) for view in _views(w)]
    again = np.flatnonzero(views[0][1:] == views[0][:-1]) + 1
    views[1][again[~np.isin(again, w.starts)]] = _REPEATED
    for start, stop in zip(w.starts[:-1], w.starts[1:], strict=True):
        keys = np.concatenate([chained(view[start:stop], n) for view in views for n in (1, 2)])
        at, n = np.unique((keys >> np.uint64(40)).astype(np.int64) % DIMENSIONS, return_counts=True)
        yield at, n / np.sqrt(np.sum(np.square(n))) if len(n) else np.zeros(0)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a state: 0 where the regularisation holds, else the leader."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def trained(rows: DataFrame) -> np.ndarray:
    """Weights, the last one the bias, from (text, quality); zeros if there are no rows."""
    spark = rows.sparkSession
    key = F.xxhash64(F.lit(9), "text")
    shards = cut(rows.select("text", "quality").repartition(SHARDS, key).sortWithinPartitions(key))
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def follow(batches, state=state):
            z0, n0 = state.value
            z, n = z0.copy(), n0.copy()
            for batch in batches:
                for part in slices(batch, size=SLICE_BYTES):
                    for (at, value), label in zip(features(words(part.column("text"), lower=False)), part.column("quality").to_pylist(), strict=True):
                        at, value = np.append(at, DIMENSIONS), np.append(value, 1.0)
                        w = weights_of(z[at], n[at])
                        g = (_sigmoid(w @ value) - label) * value
                        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                        z[at] += g - step * w
                        n[at] += g * g
            at = np.flatnonzero(n != n0)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(z[at] - z0[at]), pa.array(n[at] - n0[at])], names=["at", "z", "n"])

        added = shards.mapInArrow(follow, "at long, z double, n double").groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        at = added["at"].to_numpy()
        z[at] += added["z"].to_numpy()
        n[at] += added["n"].to_numpy()
        state.destroy()
    return weights_of(z, n)


def scored(docs: DataFrame, labels: DataFrame, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score of each row's text, as ``name`` (one of that name is replaced).

    ``labels`` has doc_id and quality (0 or 1). Only rows outside the held-out fold
    are learnt from, about ``SAMPLE_ROWS`` of them. The text alone gives the score:
    empty and null texts all get the score of the bias. Rows without quality or
    doc_id aren't learnt from; of a document labelled twice the lower label counts.
    Without labels all scores are 0.5. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(name)
    usable = cut(
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    share = min(1.0, SAMPLE_ROWS / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about SAMPLE_ROWS short rows, so one side of this join is small whatever the input
    weights = trained(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    known = spark.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches):
        w = known.value
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                sums = [float(w[at] @ value) for at, value in features(words(part.column("text"), lower=False))]
                scores = pa.array(_sigmoid(np.array(sums, np.float64) + float(w[-1])))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(score: Column) -> Column:
    return score >= THRESHOLD


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text); see ``scored``.

    Rows without doc_id are not held out. Other columns are not read.
    """
    rows = scored(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), labels, "score")
    return rows.select("doc_id", "held_out", "score", accepted(F.col("score")).cast("int").alias("predicted"))
