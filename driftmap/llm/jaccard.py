"""Exact self-join of word-shingle sets by Jaccard similarity, and its components.

Set-relation skipping. Equal sets are one class. Each class posts its rarest
shingles in an inverted index whose lists carry size and position, so that a block
of entries that is out of reach by size or position is skipped. Where lists show
many classes close to one of them (the leader), the others are written as their
difference from the leader, and their answers follow from the leader's:

* a class within the threshold of the leader shares the leader's component, so two
  such classes are never compared;
* any other class of the leader is compared by differences only. With a and b
  shingles of difference, c of them common, two sets differ in a + b - 2c shingles;
  a link needs c above a bound, which prunes by a prefix of the differences.

Pairs under different leaders are verified on their whole sets. Nothing is capped:
the choice of leaders and of the order of shingles moves work, not results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.llm.cuts import bounded, components, cut
from driftmap.llm.words import shingle_sets, slices, words

#: The order of shingles knows so many frequent shingles, and so many frequent words, by their counts.
FREQUENT = (1 << 19, 1 << 18)
#: A shingle, or word, is reported for that order if it comes so often in one slice.
LOCAL_COUNT = (2, 3)
#: A class may follow a leader that leads the lists of one in so many of its prefix shingles,
FOLLOW = 8
#: Leaders that follow others hand their followers on so many times.
HAND_ON = 3
#: and does if their sets are that similar.
LEADER_SIMILARITY = 0.5


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles and their counts, and the same of frequent words.

    They only order shingles, so a bounded, approximate list is enough.
    """

    def local(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                if not len(w.codes):
                    continue
                shingles, n = np.unique(np.concatenate([s for s, _ in shingle_sets(w, k)]), return_counts=True)
                uses = np.bincount(w.codes, minlength=len(w.vocabulary))
                for kind, keys, counts in ((0, shingles, n), (1, w.hashes(), uses)):
                    often = counts >= LOCAL_COUNT[kind]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(often.sum(), kind, np.int32)), pa.array(keys[often].view(np.int64)), pa.array(counts[often].astype(np.int64)),
                    ], names=["kind", "key", "n"])

    counts = cut(docs.select("text").mapInArrow(local, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 4).cast("int")
    levels = counts.groupBy("kind", level.alias("level")).count().collect()
    out = []
    for kind in (0, 1):
        room, least = FREQUENT[kind], 0
        for row in sorted((r for r in levels if r["kind"] == kind), key=lambda r: -r["level"]):
            room -= row["count"]
            if room < 0:
                least = row["level"] + 1
                break
        rows = counts.where((F.col("kind") == kind) & (level >= least)).toArrow()
        keys = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        out += [keys[order], rows["n"].to_numpy()[order]]
    return tuple(out)


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, 0 for keys that are not known."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return np.where(known[at] == keys, values[at], 0)


def prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, cls, prefix) of every document: set size, digest of its set, rarest shingles.

    ``cls`` is null where the set is empty. Two sets with the threshold of
    similarity share a shingle of their prefixes, whatever the order. Shingles that
    are not frequent themselves are ordered by how frequent their words are, which
    puts those in front that hardly any other text holds.
    """
    order = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))

    def read(batches):
        shingles, held, known, uses = order.value
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                costs = np.log2(looked_up(w.hashes(), known, uses) + 1).astype(np.int64)
                sizes, digests, heads = [], [], []
                for s, cost in shingle_sets(w, k, costs):
                    n = len(s)
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                    length = n - -(-num * n // den) + 1 if n else 0
                    heads.append(s[np.lexsort((cost, looked_up(s, shingles, held)))[:length]].view(np.int64))
                ends = np.cumsum([0, *map(len, heads)])
                values = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                ], names=["doc_id", "n", "cls", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, cls binary, prefix array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of each wanted (doc_id, cls, digest); the shingles are sorted and distinct."""

    def read(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [s for s, _ in shingle_sets(words(part.column("text")), k)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                same = [d == c for d, c in zip(digests, part.column("digest").to_pylist(), strict=True)]
                sets = [s for s, x in zip(sets, same, strict=True) if x]
                ends = np.cumsum([0, *map(len, sets)])
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("cls").filter(pa.array(same, pa.bool_())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                ], names=["cls", "shingles"])

    texts = docs.select("doc_id", "text").join(bounded(wanted), "doc_id").select("cls", "digest", "text")
    return texts.mapInArrow(read, "cls long, shingles array<long>").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def linked(common: Column, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    return common * den >= (n_a + n_b - common) * num


def links(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between classes that give the components of all links.

    ``classes`` has cls (a number), digest, doc_id, n, prefix. Links within a leader's neighbourhood
    are left out where both ends are linked to the leader.
    """
    t, g = num / den, (den - num) / (den + num)
    posts = classes.select("cls", "n", F.posexplode("prefix").alias("pos", "shingle"))
    lists = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("listed")).where("listed > 1")
    posts = cut(posts.join(lists, "shingle"))

    # leaders: of the classes that a class meets, the one whose shingles are listed most
    weights = posts.groupBy("cls").agg(F.sum("listed").alias("weight"))
    weighed = posts.select("shingle", "cls", "n").join(weights, "cls")
    heads = weighed.groupBy("shingle").agg(F.max(F.struct("weight", "cls", "n")).alias("head"))
    length = F.col("n") - F.ceil(F.col("n") * num / den - 1e-9) + 1
    picks = cut(
        weighed.join(heads, "shingle").where(F.struct("head.weight", "head.cls") > F.struct("weight", "cls"))
        .groupBy("cls", "n", "head").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") * FOLLOW >= length)
        .groupBy("cls", "n").agg(F.max("head").alias("head"))
        .select("cls", "n", F.col("head.cls").alias("leader"), F.col("head.n").alias("leader_n"))
    )
    # a leader that follows another one hands its followers on; where that goes on too long, they stand alone
    for _ in range(HAND_ON):
        upper = picks.select(F.col("cls").alias("leader"), F.col("leader").alias("upper"), F.col("leader_n").alias("upper_n"))
        picks = cut(
            picks.join(upper, "leader", "left")
            .select("cls", "n", F.coalesce("upper", "leader").alias("leader"), F.coalesce("upper_n", "leader_n").alias("leader_n"))
        )
    picks = cut(picks.join(picks.select(F.col("cls").alias("leader")), "leader", "left_anti"))
    ends = picks.select("cls").union(picks.select("leader")).distinct()
    sets = cut(whole_sets(docs, cut(ends.join(classes.select("cls", "doc_id", "digest"), "cls")), k))
    whole = lambda of, s: of.select(F.col("cls").alias(s), F.col("shingles").alias(f"set_{s}"))
    union = F.col("n") + F.col("leader_n") - F.col("common")
    members = cut(
        picks.join(whole(sets, "cls"), "cls").join(whole(sets, "leader"), "leader")
        .withColumn("common", F.size(F.array_intersect("set_cls", "set_leader"))).where(F.col("common") >= union * LEADER_SIMILARITY)
        .select("cls", "n", "leader", "leader_n", linked(F.col("common"), F.col("n"), F.col("leader_n"), num, den).alias("near"),
                F.concat(F.array_except("set_cls", "set_leader"), F.array_except("set_leader", "set_cls")).alias("diff"))
    )
    direct = members.where("near").select(F.col("cls").alias("a"), F.col("leader").alias("b"))

    # different leaders: list blocks by leader are paired, then their entries by size, number and position
    led = cut(posts.join(members.select("cls", "leader"), "cls", "left").select("shingle", "cls", "n", "pos", F.coalesce("leader", "cls").alias("leader")))
    blocks = led.groupBy("shingle", "leader").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    several = blocks.groupBy("shingle").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    blocks = blocks.join(several, "shingle").select("shingle", "leader", "least", "most")
    block = lambda s: blocks.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("leader", "least", "most")))
    pairs = (
        block("a").join(block("b"), "shingle")
        .where((F.col("leader_a") < F.col("leader_b")) & (F.col("most_a") * den >= F.col("least_b") * num) & (F.col("most_b") * den >= F.col("least_a") * num))
        .select("shingle", "leader_a", "leader_b")
    )
    side = lambda s: led.select("shingle", F.col("leader").alias(f"leader_{s}"), F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("pos").alias(f"pos_{s}"))
    both = F.col("n_a") + F.col("n_b")
    rest = F.least(F.col("n_a") - F.col("first_a"), F.col("n_b") - F.col("first_b"))
    fewest = F.ceil(both * num / (den + num) - 1e-9) + 1 - F.ceil(F.greatest("n_a", "n_b") * num / den - 1e-9)
    across = cut(
        pairs.join(side("a"), ["shingle", "leader_a"]).join(side("b"), ["shingle", "leader_b"])
        .where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
        .groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"), F.min("pos_a").alias("first_a"), F.min("pos_b").alias("first_b"))
        .where((F.col("shared") >= fewest) & (rest * (den + num) >= both * num)).select("a", "b", "n_a", "n_b")
    )

    ends = across.select(F.col("a").alias("cls")).union(across.select("b")).distinct().join(sets, "cls", "left_anti")
    sets = sets.union(cut(whole_sets(docs, cut(ends.join(classes.select("cls", "doc_id", "digest"), "cls")), k)))
    across = (
        across.join(whole(sets, "a"), "a").join(whole(sets, "b"), "b")
        .where(linked(F.size(F.array_intersect("set_a", "set_b")), F.col("n_a"), F.col("n_b"), num, den)).select("a", "b")
    )

    # one leader: by differences
    size, half = F.size("diff"), F.lit(0.5)
    far = F.ceil(size - (F.col("n") + F.col("n") / t) * g - 1e-9)
    need_far = F.greatest(F.lit(1), far, F.floor(half * (size - (F.col("n") + F.col("leader_n")) * g) - 1e-9) + 1)
    need_any = F.greatest(F.lit(1), far, F.floor(half * (size + (F.col("leader_n") - F.col("n")) * g) - 1e-9) + 1)
    need_any = F.when(F.col("near"), F.greatest(F.lit(1), F.floor(half * (size + (F.col("leader_n") - F.col("n")) * g) - 1e-9) + 1)).otherwise(need_any)
    apart = members.where("NOT near").select("leader").distinct()
    differing = members.join(apart, "leader", "left_semi")
    shown = differing.select("leader", "cls", F.explode("diff").alias("x"))
    rarity = shown.groupBy("leader", "x").agg(F.count(F.lit(1)).alias("held"))
    ordered = (
        shown.join(rarity, ["leader", "x"]).groupBy("leader", "cls")
        .agg(F.sort_array(F.collect_list(F.struct("held", "x"))).alias("ranked"))
        .join(differing, ["leader", "cls"])
    )
    entry = lambda need: F.explode(F.slice("ranked", 1, F.greatest(F.lit(0), size - need + 1).cast("int"))).alias("e")
    ordered = cut(ordered)
    probe = ordered.where("NOT near").select("leader", F.col("cls").alias("a"), entry(need_far)).where("e.held > 1").select("leader", "a", F.col("e.x").alias("x"))
    posted = ordered.select("leader", F.col("cls").alias("b"), "near", entry(need_any)).where("e.held > 1").select("leader", "b", "near", F.col("e.x").alias("x"))
    within = (
        probe.join(posted, ["leader", "x"]).where((F.col("a") != F.col("b")) & (F.col("near") | (F.col("a") < F.col("b"))))
        .select("a", "b").distinct()
    )
    part = lambda side: ordered.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("diff").alias(f"diff_{side}"))
    apart_by = F.size("diff_a") + F.size("diff_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    within = (
        within.join(part("a"), "a").join(part("b"), "b")
        .where(apart_by * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b")
    )

    return direct.union(within).union(across)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text).

    Two documents link when their sets of distinct ``k``-word shingles have
    ``den * intersection >= num * union``; ``component_id`` is the smallest doc_id
    that can be reached by links. A text of fewer words is one shingle. A null or
    blank text has no shingle and stays alone, as does a row without doc_id, whose
    component is null. Repeated rows are one document each. Other columns are not
    read, so their names don't matter. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    read = cut(prefixes(docs, k, num, den))
    classes = cut(
        read.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("cls").alias("digest"))
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        # a short name of each set, fixed by the cut, for all that is shuffled from here on
        .withColumn("cls", F.monotonically_increasing_id())
    )
    joined = components(links(docs, classes, k, num, den))
    smallest = (
        joined.join(classes.select(F.col("cls").alias("node"), "doc_id"), "node")
        .groupBy("label").agg(F.min("doc_id").alias("component_id"))
    )
    found = joined.join(smallest, "label").select(F.col("node").alias("cls"), "component_id")
    named = cut(classes.join(found, "cls", "left").select(F.col("digest").alias("cls"), F.coalesce("component_id", "doc_id").alias("component_id")))
    ids = read.select("doc_id", F.col("n").alias("n_shingles"), "cls")
    with_class = ids.where("cls IS NOT NULL AND doc_id IS NOT NULL").join(named, "cls").select("doc_id", "n_shingles", "component_id")
    alone = ids.where("cls IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).alias("component_id"))
    return with_class.union(alone)
