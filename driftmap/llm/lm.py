"""Language-model scores from a log-frequency Bloom filter.

Counts of n-grams are quantised to levels of the base 2 logarithm, and an n-gram of
level q enters the filter q times, with the levels 1 to q. Asking for levels 1, 2, ...
until one is missing gives the level back: never too low, and too high only by the
filter's false positives. The filter consists of segments by the hash of the
n-gram, which are built apart. Workers get as many of them at a time as fit
``FILTER_BYTES``; if that is not all, the texts are read once for each group of
segments, and a pass scores the words whose longest n-gram belongs to its group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.llm.cuts import cut
from driftmap.llm.words import Words, chained, mixed, slices, words

ORDER = 2
BITS_PER_ENTRY, PROBES = 10, 5
#: Bytes of the filter that workers hold at a time, beside at least one segment; more takes more passes.
FILTER_BYTES = 512 << 20
#: Text bytes for each segment of the filter.
SEGMENT_BYTES = 4 << 20
#: Words whose counts all workers know; the others' are joined.
FREQUENT = 1 << 18
#: Weight of the shorter context: a context seen so often counts half.
BACK_OFF = 8.0
#: Keys that are looked up or set in the filter at a time.
CHUNK = 1 << 17
#: The end of a text as a token; no word holds a line feed.
END = "\n"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def with_ends(w: Words) -> Words:
    """The words of each text and its end."""
    end = len(w.vocabulary)
    codes = np.insert(w.codes.astype(np.int64), w.starts[1:], end)
    return Words(w.starts + np.arange(len(w.starts)), codes, pa.concat_arrays([w.vocabulary.cast(pa.string()), pa.array([END])]))


def _grams(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and the places of their last words; none crosses two texts."""
    last = np.arange(n - 1, len(hashes))
    number = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = number[last] == number[last - (n - 1)]
    return chained(hashes, n)[inside], last[inside]


def _places(keys: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    """Bits of a segment that hold (key, level): a row for each probe."""
    first = mixed(keys + np.uint64(level * 0xD1B54A32D192ED03 % 2**64))
    second = mixed(first + np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
    return np.stack([(first + np.uint64(j) * second) % bits for j in range(PROBES)])


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def _build(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of one segment with all its keys."""
    levels = _levels(counts)
    size = int(max(8, levels.sum() * BITS_PER_ENTRY // 8))
    bits = np.zeros(size * 8, np.uint8)
    for start in range(0, len(keys), CHUNK):
        some, high = keys[start:start + CHUNK], levels[start:start + CHUNK]
        for level in range(1, int(high.max()) + 1):
            bits[_places(some[high >= level], level, np.uint64(size * 8)).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class CountFilter:
    """Segments ``first`` and following of ``of`` in one array; ``counts`` gives the middle of the level of each key in them, else 0."""

    def __init__(self, segments: list[bytes], first: int = 0, of: int | None = None) -> None:
        sizes = np.array([len(s) for s in segments], np.int64)
        self.first, self.of = first, np.uint64(len(segments) if of is None else of)
        self.bits, self.starts = (sizes * 8).astype(np.uint64), np.concatenate(([0], np.cumsum(sizes)))[:-1] * 8
        self.data = np.frombuffer(b"".join(segments), np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether the segment of a key is one of these."""
        segment = (keys % self.of).astype(np.int64) - self.first
        return (segment >= 0) & (segment < len(self.bits))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._counts(keys[i:i + CHUNK]) for i in range(0, len(keys), CHUNK))])

    def _counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        segment = (keys % self.of).astype(np.int64) - self.first
        left, level = np.flatnonzero(self.holds(keys)), 0
        while len(left):
            level += 1
            at = self.starts[segment[left]] + _places(keys[left], level, self.bits[segment[left]]).astype(np.int64)
            held = np.all((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1, axis=0)
            left = left[held]
            out[left] = (3 * 2.0 ** (level - 1) - 1) / 2 if level < 60 else out[left]
            if level >= 60:
                break
        return out


def built_segments(train: DataFrame, order: int) -> tuple[DataFrame, int]:
    """(segment, longest, bits) of the filter over all n-grams of the texts, of one to ``order`` words, and the number of segments.

    ``longest`` tells n-grams of ``order`` words from shorter ones.
    """
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // SEGMENT_BYTES))

    def gather(batches):
        for batch in batches:
            for part in slices(batch):
                w = with_ends(words(part.column("text")))
                hashes = w.hashes()[w.codes]
                for k in range(1, order + 1):
                    keys, counts = np.unique(_grams(hashes, w.starts, k)[0], return_counts=True)
                    if not len(keys):
                        continue
                    segment = (keys % np.uint64(n)).astype(np.int64)
                    by = np.argsort(segment, kind="stable")
                    found, at = np.unique(segment[by], return_index=True)
                    pieces = [(keys[by[a:b]], counts[by[a:b]]) for a, b in zip(at, [*at[1:], len(by)], strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(found), pa.array(np.full(len(found), k, np.int32)),
                        pa.array([x.tobytes() for x, _ in pieces], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in pieces], pa.binary()),
                    ], names=["segment", "k", "keys", "counts"])

    def build(group: pa.Table) -> pa.Table:
        out = []
        for longest in (False, True):
            some = group.filter(pc.equal(pc.equal(group["k"], order), longest))
            if some.num_rows:
                keys = np.concatenate([np.frombuffer(x, np.uint64) for x in some["keys"].to_pylist()])
                counts = np.concatenate([np.frombuffer(x, np.uint32) for x in some["counts"].to_pylist()])
                keys, inverse = np.unique(keys, return_inverse=True)
                out.append((group["segment"][0].as_py(), longest, _build(keys, np.bincount(inverse, weights=counts))))
        segment, longest, bits = zip(*out, strict=True)
        return pa.table({"segment": pa.array(segment, pa.int64()), "longest": pa.array(longest), "bits": pa.array(bits, pa.binary())})

    gathered = train.select("text").mapInArrow(gather, "segment long, k int, keys binary, counts binary")
    return cut(gathered.groupBy("segment").applyInArrow(build, "segment long, longest boolean, bits binary")), n


def _runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of places whose sizes add up to ``most``, or that are one place; they cover all."""
    out, start, used = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and used + size > most:
            out.append((start, i))
            start, used = i, 0
        used += size
    return [*out, (start, len(sizes))]


def _loaded(built: DataFrame, sizes: list[int], longest: bool, start: int, stop: int) -> CountFilter:
    """The segments from ``start`` up to ``stop``, fetched an eighth of ``FILTER_BYTES`` at a time."""
    segments = [bytes(8)] * (stop - start)
    for a, b in _runs(sizes[start:stop], FILTER_BYTES // 8):
        rows = built.where((F.col("longest") == longest) & (F.col("segment") >= start + a) & (F.col("segment") < start + b)).toArrow()
        for i, bits in zip(rows["segment"].to_pylist(), rows["bits"], strict=True):
            segments[i - start] = bits.as_py()
    return CountFilter(segments, start, len(sizes))


def _log_shares(w: Words, shorter: CountFilter, longest: CountFilter, order: int, scale: float) -> np.ndarray:
    """log10 of the probability of each word whose longest n-gram is in the segments of ``longest``, 0 for others.

    Words at the start of a text, which end no n-gram of ``order`` words, go with segment 0.
    """
    model = lambda n: longest if n == order else shorter
    hashes = w.hashes()
    keys = chained(hashes, 1)
    contexts = model(1).counts(keys)[w.codes]
    mine = longest.holds(keys)[w.codes] if order == 1 else np.full(len(w.codes), longest.first == 0)
    p = (contexts + 1) / scale
    longer = hashes[w.codes]
    for n in range(2, order + 1):
        keys, at = _grams(longer, w.starts, n)
        seen = np.zeros(len(p))
        seen[at] = model(n).counts(keys)
        if n == order:
            mine[at] = longest.holds(keys)
        before = np.concatenate(([0.0], contexts[:-1]))
        first = np.ones(len(p), bool)
        first[at] = False
        before[first] = 0
        share = before / (before + BACK_OFF)
        p = share * np.minimum(1, seen / np.maximum(before, 1)) + (1 - share) * p
        contexts = seen
    return np.where(mine, np.log10(p), 0.0)


def _pass_scores(docs: DataFrame, shorter, held, order: int, scale: float) -> DataFrame:
    """(digest, part) of each distinct text: what the words of one group of segments add to its score."""

    def score(batches):
        for batch in batches:
            for part in slices(batch):
                w = with_ends(words(part.column("text")))
                sums = np.add.reduceat(_log_shares(w, shorter.value, held.value, order, scale), w.starts[:-1])
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(sums)], names=["digest", "part"])

    return docs.select("digest", "text").mapInArrow(score, "digest string, part double").groupBy("digest").agg(F.max("part").alias("part"))


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs`` (doc_id, text).

    Learns from all rows that are not held out. ``base_score`` has the exact counts
    of single words; ``score`` is the sum of log10 of probabilities that mix, from
    the single word up, the counts of longer contexts out of the filter. A null or
    blank text is its end alone. A row without doc_id is not held out. Repeated rows
    count and are scored each. Other columns are not read. Without any row to learn
    from all counts are 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    train = docs.where("NOT held_out").select("text")

    def tokens(batches):
        for batch in batches:
            for part in slices(batch):
                w = with_ends(words(part.column("text")))
                n = np.bincount(w.codes, minlength=len(w.vocabulary))
                yield pa.RecordBatch.from_arrays([w.vocabulary.filter(pa.array(n > 0)), pa.array(n[n > 0])], names=["token", "n"])

    counts = cut(train.mapInArrow(tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.floor(F.log2("n") * 4).cast("int")
    room, least = FREQUENT, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            least = row["level"] + 1
            break
    frequent = counts.where(level >= least).toArrow()
    exact = spark.sparkContext.broadcast(dict(zip(frequent["token"].to_pylist(), frequent["n"].to_pylist(), strict=True)))
    scale = float(total + distinct + 1)
    built, n = built_segments(train, order)
    sizes = {True: [8] * n, False: [8] * n}
    for row in built.select("segment", "longest", F.octet_length("bits").alias("size")).collect():
        sizes[row["longest"]][row["segment"]] = row["size"]
    groups = _runs(sizes[True], FILTER_BYTES - sum(sizes[False]))
    shorter = spark.sparkContext.broadcast(_loaded(built, sizes[False], False, 0, n))
    held = spark.sparkContext.broadcast(_loaded(built, sizes[True], True, *groups[0]))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256) if len(groups) > 1 else F.lit(None).cast("string")
    docs = docs.withColumn("digest", digest)

    def score(batches):
        known = exact.value
        for batch in batches:
            for part in slices(batch):
                w = with_ends(words(part.column("text")))
                vocabulary = w.vocabulary.to_pylist()
                c = np.fromiter((known.get(x, 0) for x in vocabulary), np.int64, len(vocabulary))
                per_text = lambda x, w=w: np.add.reduceat(x, w.starts[:-1])  # noqa: E731  every text has its end
                logs = _log_shares(w, shorter.value, held.value, order, scale)
                number = np.repeat(np.arange(len(w.starts) - 1), np.diff(w.starts))
                rare = c[w.codes] == 0
                pairs, times = np.unique(number[rare] * len(vocabulary) + w.codes[rare], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(w.starts)) * len(vocabulary))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(np.diff(w.starts)),
                    pa.array(per_text((c[w.codes] > 0).astype(np.int64))), pa.array(per_text(np.log10(c[w.codes] + 1.0))), pa.array(per_text(logs)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), w.vocabulary.take(pa.array(pairs % len(vocabulary)))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times)), part.column("digest"),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "known", "score", "rare", "times", "digest"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, known double, score double, rare array<string>, times array<long>, digest string"
    scored = cut(docs.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()))
    for start, stop in groups[1:]:
        part = cut(_pass_scores(docs, shorter, spark.sparkContext.broadcast(_loaded(built, sizes[True], True, start, stop)), order, scale))
        scored = cut(scored.join(part, "digest").withColumn("score", F.col("score") + F.col("part")).drop("part"))
    rare = scored.select("row", F.explode(F.arrays_zip(F.col("rare").alias("token"), F.col("times").alias("times"))).alias("r")).select("row", "r.*")
    more = (
        rare.join(counts.where(level < least), "token").groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    )
    return scored.drop("rare", "times", "digest").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(scale))).alias("base_score"), "score",
    )
