"""Product codes of vectors: codebooks by rounds of nearest entries, with adaptive bounds (Drake and Hamerly).

Vectors become integers and are cut into equal parts; each part position has its own
codebook. A row keeps, for each of its parts, the ``b`` entries that were nearest in
the order of their distance, a lower bound for each of them, and one outer bound for
all entries beyond. When entries move, the bounds shrink by their movement; a part
whose entry is surely nearer than the next bound needs no other distance, else only
the entries before the first bound that holds are compared, and all of them if not
even the outer bound holds. Bounds are floating-point with a margin; whatever they
don't decide is decided by exact integer distances, ties to the smaller index. ``b``
follows the places that the round before needed.

Rows with their bounds are written once a round in the shared folder. Each task adds
up its parts by entry, so a round shuffles at most one row a task and entry, and the
driver gets one row an entry.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm.cuts import bounded, cut
from driftmap.session import shared_dir

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components are held within this distance of 0, so that the error of 4,096 components fits in 64 bits.
LARGEST = 1 << 24
#: Vectors whose distances to all entries are in memory at a time.
BLOCK = 8_192
#: Bounds are rounded; a difference below this share of them is settled by integers.
MARGIN = 1e-9

@dataclass
class Bounds:
    """State of the n vectors of one part: entries in rising distance, their bounds (the first one's is exact), and the outer bound."""

    near: np.ndarray  # n, b
    low: np.ndarray  # n, b
    outer: np.ndarray  # n


def squared(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer distances (n, k) of n parts to k entries, or to k entries each (n, k, width)."""
    total = 0
    for d in range(part.shape[-1]):
        total = total + np.square(part[:, d, None] - entries[..., d])
    return total if part.shape[-1] else np.zeros((len(part), entries.shape[-2]), np.int64)


def fresh(part: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
    """Bounds from the distances to all entries."""
    found = squared(part, entries)
    order = np.argsort(found, axis=1, kind="stable")[:, : b + 1]
    low = np.sqrt(np.take_along_axis(found, order, 1).astype(np.float64))
    outer = low[:, b] if order.shape[1] > b else np.full(len(part), np.inf)
    return Bounds(order[:, :b], low[:, :b], outer)


def moved(part: np.ndarray, old: Bounds, entries: np.ndarray, steps: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds after each entry moved by ``steps`` at most, and how many entries each part had to compare.

    A part compares its first ``need`` entries, or all if ``need`` is more than the
    bounds kept. ``b`` is at most the number kept so far.
    """
    kept = old.near.shape[1]
    near, low = old.near.copy(), old.low - steps[old.near]
    low[:, 0] = np.sqrt(squared(part, entries[near[:, :1]])[:, 0].astype(np.float64))
    outer = old.outer - steps.max(initial=0.0)
    # the least that any entry from place z on can be away
    rest = np.minimum.accumulate(np.concatenate([low[:, 1:], outer[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    holds = low[:, :1] * (1 + MARGIN) + MARGIN < rest * (1 - MARGIN)
    need = np.where(holds.any(1), holds.argmax(1) + 1, len(entries))
    for z in range(2, kept + 1):
        at = np.flatnonzero(need == z)
        if not len(at):
            continue
        found = squared(part[at], entries[near[at, :z]])
        order = np.lexsort((near[at, :z], found), axis=1)
        near[at, :z] = np.take_along_axis(near[at, :z], order, 1)
        low[at, :z] = np.sqrt(np.take_along_axis(found, order, 1).astype(np.float64))
    out = Bounds(near[:, :b], low[:, :b], np.minimum(outer, low[:, b:].min(1)) if b < kept else outer)
    at = np.flatnonzero(need > kept)
    if len(at):
        again = fresh(part[at], entries, b)
        out.near[at], out.low[at], out.outer[at] = again.near, again.low, again.outer
    return out, need


def _integers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), PARTS, -1).astype(np.int64)


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x, kind)], pa.binary())


def _with(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names if n not in more} | more
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _below(x: list[np.ndarray]) -> np.ndarray:
    """Bounds in 32 bits, never larger than they were."""
    return np.nextafter(np.stack(x, 1).astype(np.float32), np.float32("-inf"))


def _parts(state: list[Bounds]) -> dict[str, pa.Array]:
    near = np.stack([s.near for s in state], 1)
    return {"near": _packed(near, "u1"), "low": _packed(_below([s.low for s in state]), "<f4"), "outer": _packed(_below([s.outer for s in state]), "<f4")}


def _state(batch: pa.RecordBatch, b: int) -> list[Bounds]:
    n = batch.num_rows
    near = np.frombuffer(b"".join(batch.column("near").to_pylist()), "u1").reshape(n, PARTS, b).astype(np.int64)
    low = np.frombuffer(b"".join(batch.column("low").to_pylist()), "<f4").reshape(n, PARTS, b).astype(np.float64)
    outer = np.frombuffer(b"".join(batch.column("outer").to_pylist()), "<f4").reshape(n, PARTS).astype(np.float64)
    return [Bounds(near[:, p], low[:, p], outer[:, p]) for p in range(PARTS)]


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def prepared(vectors: DataFrame, key: str, column: str, *keep: str) -> tuple[DataFrame, int]:
    """(key, keep, v): whole vectors as 32-bit integers, and the number of components of a part.

    Vectors that are null, have no component, or have a null or non-finite one are
    dropped, as are those whose number of components isn't that of the vector with
    the smallest key. Zeros fill the last part up.
    """
    usable = vectors.select(key, *keep, F.col(column).alias("__v")).where(
        F.col("__v").isNotNull() & (F.size("__v") > 0)
        & F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    first = usable.orderBy(F.col(key).asc_nulls_last(), "__v").select(F.size("__v").alias("n")).first()
    size = first["n"] if first else PARTS
    width = -(-size // PARTS)

    def pack(batches):
        for batch in batches:
            lists = batch.column("__v")
            if not batch.num_rows:
                continue
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, size)
            x = np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype("<i4")
            x = np.pad(x, ((0, 0), (0, PARTS * width - size)))
            yield _with(batch.drop_columns(["__v"]), {"v": _packed(x, "<i4")})

    kept = usable.where(F.size("__v") == size).withColumn("__v", F.col("__v").cast("array<double>"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.drop("__v").schema)
    return kept.mapInArrow(pack, f"{fields}, v binary"), width


def _sums(rows: DataFrame, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): members of each entry in use and the sums of their components."""

    def add(batches):
        n, total = np.zeros(PARTS * ENTRIES, np.int64), np.zeros((PARTS * ENTRIES, width), np.int64)
        for batch in _blocks(batches):
            v = _integers(batch.column("v"))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), "u1").reshape(-1, PARTS) + np.arange(PARTS) * ENTRIES
            n += np.bincount(code.ravel(), minlength=len(n))
            np.add.at(total, code.ravel(), v.reshape(-1, width))
        at = np.flatnonzero(n)
        columns = [at // ENTRIES, at % ENTRIES, n[at], *total[at].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *[f"s{d}" for d in range(width)]])

    sums = ", ".join(f"s{d} long" for d in range(width))
    parts = rows.select("v", "code").mapInArrow(add, f"part long, entry long, n long, {sums}")
    wide = [F.sum(F.col(f"s{d}").cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    return parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide)


def _assigned(rows: DataFrame, books: np.ndarray, steps: np.ndarray | None, kept: int, b: int, folder: str) -> DataFrame:
    """``rows`` with code, error, need and bounds, written to ``folder`` and read from there.

    ``books`` are PARTS x entries x width integers, ``steps`` how far each entry moved
    (None: there are no bounds yet). ``need`` has the number of entries that each part compared.
    """

    base = rows.drop("code", "error", "need", "near", "low", "outer")
    names = base.columns

    def run(batches):
        for batch in _blocks(batches):
            v = [np.ascontiguousarray(x) for x in _integers(batch.column("v")).swapaxes(0, 1)]
            if steps is None:
                state = [fresh(part, book, b) for part, book in zip(v, books, strict=True)]
                needs = [np.full(batch.num_rows, books.shape[1])] * PARTS
            else:
                found = [moved(part, old, book, step, b) for part, old, book, step in zip(v, _state(batch, kept), books, steps, strict=True)]
                state, needs = zip(*found, strict=True)
            code = np.stack([s.near[:, 0] for s in state], 1)
            error = sum(squared(v[p], books[p][code[:, p : p + 1]])[:, 0] for p in range(PARTS))
            yield _with(batch.select(names), {
                "code": _packed(code, "u1"), "error": pa.array(error, pa.int64()), "need": _packed(np.stack(needs, 1), "u1"), **_parts(state),
            })

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    out = rows.mapInArrow(run, f"{fields}, code binary, error long, need binary, near binary, low binary, outer binary")
    out.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def needed(rows: DataFrame) -> np.ndarray:
    """How many parts compared 0, 1, 2, ... entries; one row a task and number is shuffled."""

    def count(batches):
        n = np.zeros(256, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column("need").to_pylist()), "u1"), minlength=256)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["need", "n"])

    found = rows.select("need").mapInArrow(count, "need long, n long").groupBy("need").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256, np.int64)
    for r in found:
        out[r["need"]] = r["n"]
    return out


def adapted(needs: np.ndarray, b: int, entries: int) -> int:
    """The next number of bounds: the most places that any part needed within them, between an eighth of the entries and ``b``."""
    within = np.flatnonzero(needs[: b + 1])
    return max(1, min(b, max(entries // 8, int(within.max(initial=1)))))


@dataclass
class Codes:
    """``rows`` (key, kept columns, code, error), the books (PARTS x entries x width), and the comparisons of each round."""

    rows: DataFrame
    books: np.ndarray
    needs: list[np.ndarray]


def encoded(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", keep: tuple[str, ...] = ()) -> Codes:
    """Codes of all usable vectors (see ``prepared``), and the books they refer to.

    A book starts as the parts of the ``ENTRIES`` vectors with the smallest keys
    (nulls last; vectors of one key in the order of their bytes; fewer if there are
    fewer vectors). After each of ``ROUNDS`` rounds, every entry in use becomes the
    floor of its members' mean. Repeated vectors count each time. Components beyond
    +-65,536 are taken as +-65,536. Without vectors there are neither rows nor entries.
    """
    spark = vectors.sparkSession
    rows, width = prepared(vectors, key, column, *keep)
    rows = cut(rows)
    start = rows.orderBy(F.col(key).asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    if not start:
        return Codes(rows.select(key, *keep, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, width), np.int64), [])
    books = np.stack([np.frombuffer(r["v"], "<i4").reshape(PARTS, width) for r in start], 1).astype(np.int64)
    folder = shared_dir(spark, "codes")
    entries = books.shape[1]
    kept = b = min(entries, max(1, entries // 4))
    steps, needs = None, []
    for turn in range(ROUNDS + 1):
        rows = _assigned(rows, books, steps, kept, b, f"{folder}/{turn}")
        if turn:
            needs.append(needed(rows))
        if turn == ROUNDS:
            break
        kept = b
        b = adapted(needs[-1], b, entries) if needs else b
        after = books.copy()
        for r in _sums(rows, width).collect():  # one row an entry in use
            after[r["part"], r["entry"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
        steps = np.sqrt(np.square(after - books).sum(2).astype(np.float64)) * (1 + MARGIN)
        books = after
    return Codes(rows.select(key, *keep, "code", "error"), books, needs)


def books_digest(books: np.ndarray) -> str:
    """Hexadecimal SHA-256 of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label); see ``encoded``.

    ``label_error`` adds up the errors of equal labels, nulls being one label.
    """
    found = encoded(vectors, keep=("label",))
    by_label = bounded(cut(found.rows.groupBy("label").agg(F.sum("error").alias("label_error"))))
    rows = found.rows.alias("x").join(by_label.alias("y"), F.col("x.label").eqNullSafe(F.col("y.label")))
    return rows.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(found.books)).alias("codebooks_sha256")
    )


def _oracle() -> str:
    """The same in DuckDB: every part against every entry, in each round."""
    size = PARTS * 4
    own = ", ".join(f"floor({SCALE} * e[4 * p + {d + 1}]::DOUBLE)::BIGINT AS v{d}" for d in range(4))
    away = " + ".join(f"(x.v{d} - b.v{d}) * (x.v{d} - b.v{d})" for d in range(4))
    mean = ", ".join(f"(s{d} - ((s{d} % n) + n) % n) // n AS v{d}" for d in range(4))
    ctes = [
        f"kept AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size})",
        f"x AS (SELECT vec_id, label, p, {own} FROM kept, range({PARTS}) t(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "b0 AS (SELECT p, k, v0, v1, v2, v3 FROM x JOIN first USING (vec_id))",
    ]
    for turn in range(ROUNDS + 1):
        ctes.append(f"a{turn} AS (SELECT x.vec_id, x.p, min(({away}) * {ENTRIES} + k) AS m FROM x JOIN b{turn} b ON b.p = x.p GROUP BY ALL)")
        if turn < ROUNDS:
            sums = ", ".join(f"sum(v{d})::HUGEINT AS s{d}" for d in range(4))
            fields = ", ".join(f"coalesce(u.v{d}, b.v{d}) AS v{d}" for d in range(4))
            ctes.append(f"s{turn} AS (SELECT p, (m % {ENTRIES})::INT AS k, count(*) AS n, {sums} FROM x JOIN a{turn} USING (vec_id, p) GROUP BY ALL)")
            ctes.append(f"b{turn + 1} AS (SELECT b.p, b.k, {fields} FROM b{turn} b LEFT JOIN (SELECT p, k, {mean} FROM s{turn}) u ON u.p = b.p AND u.k = b.k)")
    return f"""
        WITH {", ".join(ctes)},
        code AS (SELECT vec_id, string_agg(printf('%02x', (m % {ENTRIES})::INT), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
        book AS (SELECT sha256(string_agg(v0 || ',' || v1 || ',' || v2 || ',' || v3, ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM code JOIN kept USING (vec_id), book"""


ORACLE = _oracle()
