"""Operators on documents against plain versions, and on rows that are odd in every way."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftmap.llm import jaccard, leaks, lm, mixing, quality, surrogates

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_entities string, cls string, score string, item_id string, block string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names operators use inside."""
    long = " ".join(f"w{i}" for i in range(40_000))
    texts = [None, "", " \t\n", "one", "Two words", long, long + " end", "a b c d e f", "a b c d e f", "A B c D e f\x0b", "x" * 200_000]
    rows = [(i, t, None if i % 3 == 0 else "s", "n", "c", "x", "i", "b") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "a b c d e f", "s", "n", "c", "x", "i", "b"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split()


def plain_components(rows, k, num, den):
    sets = []
    for i, text in rows:
        w = tokens(text)
        sets.append((i, {tuple(w)} if 0 < len(w) < k else {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            common = len(s & t)
            if s and t and den * common >= num * (len(s) + len(t) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_equals_all_pairs(docs, rows, k, num):
    found = docs.select("doc_id", "text").collect()
    assert rows(jaccard.jaccard_components(docs, k, num, 100)) == sorted(plain_components(found, k, num, 100), key=repr)


def test_jaccard_groups_of_near_copies(spark, rows):
    """A group around one text, where most copies are near that text and not near each other."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(120):
        w = base[:]
        for n in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"n{i}_{n}"
        texts.append(" ".join(w[rng.randint(0, 3):]))
    texts += [" ".join(base[:60] + [f"o{i}_{j}" for j in range(60)]) for i in range(40)]
    found = list(enumerate(texts))
    df = spark.createDataFrame(found, "doc_id long, text string")
    assert rows(jaccard.jaccard_components(df, 3, 90, 100)) == sorted(plain_components(found, 3, 90, 100), key=repr)


def test_jaccard_odd(odd, empty, rows):
    got = rows(jaccard.jaccard_components(odd, 3, 90, 100))
    assert (0, 0, 0) in got and (3, 1, 3) in got and (6, 39_999, 5) in got and (None, 4, None) in got and (None, 0, None) in got
    assert got.count((7, 4, 7)) == 2 and (8, 4, 7) in got and (9, 4, 7) in got and len(got) == 14
    assert rows(jaccard.jaccard_components(empty)) == []


def plain_contained(docs, items, k=5, percent=80):
    """Every document row against every item row, on sets of runs of words."""
    best = {}
    for item_id, item in items:
        w = tokens(item)
        size = min(k, len(w))
        wanted = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if size else set()
        for doc_id, text in docs:
            d = tokens(text)
            shared = len(wanted & {tuple(d[j:j + size]) for j in range(len(d) - size + 1)})
            if None not in (item_id, doc_id, item, text) and wanted and shared * 100 >= len(wanted) * percent:
                best[doc_id, item_id] = max(best.get((doc_id, item_id), (0, 0, 0)), (shared / len(wanted), shared, len(wanted)))
    return sorted(((d, i, m, shared, share) for (d, i), (share, shared, m) in best.items()), key=repr)


def test_leaks_odd(spark, odd, empty, rows):
    items = [(1, "A b C d e f"), (2, "w100 w101 w102 w103 w104 w105 w106 w107"), (3, "a b"), (4, None), (None, "a b c d e f"), (5, ""), (6, "ONE"), (7, "words two"), (8, "x" * 200_000), (8, "b c")]
    found = spark.createDataFrame(items, "item_id long, text string")
    got = rows(leaks.contained_items(odd, found))
    assert got == plain_contained([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    assert (7, 1, 2, 2, 1.0) in got and (5, 2, 4, 4, 1.0) in got and (8, 3, 1, 1, 1.0) in got and (3, 6, 1, 1, 1.0) in got and not {7} & {r[1] for r in got}
    assert rows(leaks.contained_items(empty, found)) == [] and rows(leaks.contained_items(odd, found.limit(0))) == []


def test_leaks_threshold(spark, rows):
    item = [f"i{n}" for n in range(54)]  # 50 shingles
    cases = {1: item, 2: item[:44], 3: item[:43], 4: ["x"] * 3000 + item[5:] + ["y"] * 3000, 5: item[:27] + ["z"] + item[28:]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in cases.items()], "doc_id long, text string")
    got = {r[0]: r[3] for r in rows(leaks.contained_items(df, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")))}
    assert got == {1: 50, 2: 40, 4: 45, 5: 45}


@pytest.mark.parametrize("sent", [200_000, 0])
def test_leaks_equal_all_pairs(spark, rows, monkeypatch, sent):
    """Items of 1 to 60 words, whole, cut, changed inside or scattered over long documents, sent to all executors or not."""
    from driftmap.llm import cuts

    monkeypatch.setattr(cuts, "BROADCAST_ROWS", sent)
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    items = [(i % 50, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 17, 40, 60])))) for i in range(60)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.choice([0, 3, 8, 60, 500]))]
        for _, item in rng.sample(items, 3):
            part = item.split()
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "z"
            if rng.random() < 0.3:
                part = part[: rng.randint(1, len(part))] + ["y"] * 4 + part[len(part) // 2:]
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((i % 110, " ".join(w)))
    schema = "id long, text string"
    got = rows(leaks.contained_items(spark.createDataFrame(docs, schema).withColumnRenamed("id", "doc_id"), spark.createDataFrame(items, schema).withColumnRenamed("id", "item_id")))
    want = plain_contained(docs, items)
    assert len(want) > 100 and [r[:4] for r in got] == [r[:4] for r in want]


def test_leaks_sketch_is_a_part_of_a_document(spark):
    """Values beyond the cutoff of a document's size are not looked up."""
    items = spark.createDataFrame([(i, " ".join(f"i{i}_{j}" for j in range(204))) for i in range(20)], "item_id long, text string")
    sketches = leaks._sketches(leaks._item_sets(items, 5), 80)
    limits = spark.createDataFrame([(159,), (160,)], "n int").select(leaks._cutoff(sketches, F.col("n")).alias("limit")).collect()
    assert limits[0]["limit"] is None and sketches.count() == 20 * 41
    assert (limits[1]["limit"] + 2**63) / 2**64 < 0.35


def test_lm_counts(docs, rows):
    got = {r["doc_id"]: r for r in lm.lm_scores(docs).collect()}
    found = docs.select("doc_id", "text").collect()
    counts = Counter()
    for i, text in found:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*tokens(text), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    for i, text in found:
        own = [*tokens(text), b"\n"]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_filter_never_reads_low(monkeypatch):
    import numpy as np

    keys = np.random.default_rng(2).integers(0, 2**63, 5_000).astype(np.uint64)
    counts = np.random.default_rng(3).integers(1, 500, 5_000)
    held = lm.CountFilter([lm._build(keys, counts)])
    levels = np.floor(np.log2(held.counts(keys) * 2 / 3 + 0.34)) + 1
    assert (levels >= lm._levels(counts)).all() and (levels == lm._levels(counts)).mean() > 0.97
    assert (held.counts(keys + np.uint64(1)) > 0).mean() < 0.03


def test_lm_frequent_words_and_joined_words_agree(docs, monkeypatch, rows):
    want = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 10)
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.lm_scores(docs).collect()} == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_filter_beyond_one_broadcast_keeps_rare_grams(docs, odd, monkeypatch, order):
    """Filters that need many passes give the scores of one that fits: nothing is dropped for room."""
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id < 9 OR doc_id IS NULL"))
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 19)
    want = sorted((repr(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in lm.lm_scores(both, order).collect())
    assert len(want) == docs.count() + 12
    monkeypatch.setattr(lm, "FILTER_BYTES", 1 << 10)
    got = sorted((repr(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in lm.lm_scores(both, order).collect())
    assert got == want


def test_lm_odd(odd, empty):
    got = lm.lm_scores(odd).collect()
    assert len(got) == 14 and sorted(r["n_tokens"] for r in got)[:4] == [1, 1, 1, 1]
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == got[0]["train_tokens"] > 0 for r in got)
    assert lm.lm_scores(empty).collect() == []


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 10, 1000, 50_000]) for i in range(9)}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        want = plain_targets(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_mixing(spark, docs):
    many = docs.crossJoin(spark.range(10)).select((F.col("doc_id") * 10 + F.col("id")).alias("doc_id"), "source", "text")
    got = mixing.mixed(many).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["size"] == len(tokens(None)) or r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    for rows_ in by.values():
        assert abs(sum(r["taken"] for r in rows_) - rows_[0]["target"]) <= max(r["size"] for r in rows_)
        assert rows_[0]["source_size"] == sum(r["size"] for r in rows_)
    assert sorted(map(tuple, mixing.mixed(many.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mixing_odd(odd, empty, rows):
    got = rows(mixing.mixed(odd))
    assert len(got) == 14 and sum(r[2] for r in got) == 80_035 and all(r[6] == r[2] * r[5] and r[5] <= 3 for r in got)
    assert rows(mixing.mixed(empty)) == []


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)
    other = docs.withColumn("doc_id", F.col("doc_id") * 5 + 100_000).withColumn("source", F.lit("x"))
    scores = {r["text"]: r["s"] for r in quality.scored(docs, labels, "s").collect()}
    weights_only = {r["text"] for r in quality.scored(other, labels.limit(0), "s").where("s = 0.5").collect()}
    assert weights_only == set(scores) and all(0 <= s <= 1 for s in scores.values())


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.quality_scores(odd, labels).collect()
    assert len(got) == 14 and len({r["score"] for r in got if r["doc_id"] in (0, 1, 2)}) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False, False]
    kept = quality.scored(odd, labels, "score")
    assert kept.columns == [c for c in odd.columns if c != "score"] + ["score"]
    assert quality.quality_scores(empty, labels).collect() == []


TEXT = (
    "Mrs. Anna Smith and Mr Smith, call +49 30 1234567 or (212) 555-1234. Card 4111 1111 1111 1111, token = "
    '"04dbebab91ab85687d33eeaaf9ac699e1188f962". Frau Иванова wrote to A.B@X.org and a.b@x.org from 10.0.0.1.'
)


def test_surrogate_kinds():
    found = list(surrogates.entities(TEXT))
    assert [k for _, _, k, _ in found] == ["female", "surname", "surname", "phone", "phone", "card", "secret", "surname", "email", "email", "ip"]
    text, n = surrogates.rewritten(TEXT, b"k", {})
    assert n == 11 and list(map(lambda e: e[2], surrogates.entities(text))) == [e[2] for e in found]
    again = list(surrogates.entities(text))
    assert again[1][3] == again[2][3] and again[8][3] == again[9][3] and surrogates.script(again[7][3]) == "cyrillic"
    assert surrogates._passes(again[5][3]) and all(a[3] != b[3] for a, b in zip(found, again, strict=True))
    assert text != surrogates.rewritten(TEXT, b"other", {})[0]
    assert surrogates.rewritten("nothing 3.14 in 2024", b"k", {}) == ("nothing 3.14 in 2024", 0)
    assert surrogates.rendered("٠١٢", "phone", "345") == "٣٤٥"


def test_surrogates_stay_distinct(spark):
    """Short names have few surrogates: collisions are drawn again until there is none."""
    names = [a + b for a in "BCDFG" for b in "aeiou"] + ["Li", "Lo"]
    df = spark.createDataFrame([(i, f"Mr {n} saw Mr {names[0]}.") for i, n in enumerate(names)], "doc_id long, text string")
    texts = [r["text"] for r in surrogates.with_surrogates(df, b"k").orderBy("doc_id").collect()]
    pairs = [[e[3] for e in surrogates.entities(t)] for t in texts]
    assert len({p[0] for p in pairs}) == len(names) and {p[1] for p in pairs} == {pairs[0][0]} and not {p[0] for p in pairs} & set(names)


@pytest.mark.parametrize(("text", "real"), [
    ("saw Mr John Paul Smith today", "John Paul Smith"), ("Mr John F. Kennedy spoke", "John Kennedy"), ("Mrs Smith-Jones left", "Smith Jones"),
    ("Dr O'Brien came", "O'Brien Brien"), ("Mr J. Smith's house", "J. Smith"), ("Frau\nMeier kam", "Meier"), ("Mr Smith came. Later Smith said, and SMITH left", "Smith SMITH"),
    ("Frau Anna von Humboldt", "Anna Humboldt"), ("call 555-123-4567 now", "123-4567"), ("ruf 030 1234567 an", "1234567"), ("dial 0044 20 7946 0958.", "7946 0958"),
    ("au 06 12 34 56 78", "12 34 56 78"), ("Tel. (030) 1234567", "1234567"),
])
def test_surrogates_leave_no_part(spark, text, real):
    import re

    new, n = surrogates.rewritten(text, b"k", {})
    assert n and re.search(surrogates.HINT.replace(r"\p{Nd}", r"\d"), text)
    assert not [x for x in (real.split() if real[0].isalpha() else [real]) if x in new], new
    assert [e[2] for e in surrogates.entities(new)] == [e[2] for e in surrogates.entities(text)]


def test_surrogates_of_what_is_no_name_or_phone():
    for text in ("on 01.02.2024 and 2024-01-02, 0.123456", "12 Elm Dr.", "Mr and Mrs said"):
        assert surrogates.rewritten(text, b"k", {}) == (text, 0)
    assert surrogates.rewritten("Elm Dr.\nThe shop. The end of the day", b"k", {})[0].endswith("The end of the day")
    new = surrogates.rewritten("Mr Smith came. Smith's dog, then Mr Smith.", b"k", {})[0]
    assert len({e[3] for e in surrogates.entities(new)}) == 1 and "'s dog" in new


def test_surrogates_odd(spark, odd, empty):
    got = surrogates.with_surrogates(odd, b"k")
    assert got.columns == [c for c in odd.columns if c != "n_entities"] + ["n_entities"]
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(map(repr, odd.select("doc_id", "text").collect()))
    assert surrogates.with_surrogates(empty, b"k").collect() == []
