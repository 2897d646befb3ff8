"""Vector codes, token alignment and toxicity."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftmap.llm import alignment, compression, queries, toxicity

LEFT, RIGHT = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


# codes of vectors

def plain_codes(rows):
    """(codes, errors, books) of integer vectors by the definition."""
    x = np.array(rows, np.int64).reshape(len(rows), compression.PARTS, -1)
    books = x[: compression.ENTRIES].swapaxes(0, 1).copy()
    for turn in range(compression.ROUNDS + 1):
        away = np.square(x[:, :, None, :] - books[None]).sum(3)
        code = away.argmin(2)
        if turn < compression.ROUNDS:
            for p in range(compression.PARTS):
                for e in range(books.shape[1]):
                    members = x[code[:, p] == e, p]
                    if len(members):
                        books[p, e] = members.sum(0) // len(members)
    return code, away.min(2).sum(1), books


def test_moved_equals_plain():
    rng = np.random.default_rng(4)
    for spread in (3, 40, 4_000):
        part = rng.integers(-spread, spread, (500, 4))
        entries = part[:64].copy()
        state = compression.fresh(part, entries, 16)
        for b in (16, 11, 11, 8):
            after = entries + rng.integers(-spread // 3, spread // 3 + 1, entries.shape) * (rng.random((64, 1)) < 0.3)
            steps = np.sqrt(np.square(after - entries).sum(1)) * (1 + compression.MARGIN)
            state, need = compression.moved(part, state, after, steps, b)
            entries = after
            away = compression.squared(part, entries)
            assert (state.near[:, 0] == away.argmin(1)).all() and state.near.shape == (500, b)
            others = np.take_along_axis(np.sqrt(away), state.near, 1)
            assert (state.low <= others * (1 + 1e-9) + 1e-9).all()
            np.put_along_axis(away, state.near, np.iinfo(np.int64).max, 1)
            assert (state.outer <= np.sqrt(away.min(1)) * (1 + 1e-9)).all()
        assert spread < 40 or (need < 64).any()


def test_adapted():
    needs = np.zeros(256, np.int64)
    needs[[1, 9, 64]] = 5
    assert compression.adapted(needs, 16, 64) == 9
    needs[9] = 0
    assert compression.adapted(needs, 16, 64) == 8 and compression.adapted(needs, 4, 64) == 4


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def test_codes_odd(spark):
    rng = random.Random(5)
    inf, nan = float("inf"), float("nan")
    good = [(i, [rng.uniform(-1, 1) for _ in range(32)], rng.choice([0, 1, None]), "x") for i in range(150)]
    good += [(200, good[3][1], 1, "x"), (200, good[3][1], 1, "x"), (None, good[7][1], None, "x"), (201, [1e30] * 32, 0, "x")]
    bad = [(-1, None, 0, "x"), (-2, [], 0, "x"), (-3, [0.5] * 31 + [None], 0, "x"), (-4, [0.5] * 31 + [nan], 0, "x"), (-5, [-inf] * 32, 0, "x"), (300, [0.5] * 16, 0, "x")]
    df = spark.createDataFrame(good + bad, VECTORS).repartition(5)
    got = compression.compressed(df).collect()
    want = [np.clip(np.floor(np.array(v, np.float32).astype(float) * 256), -compression.LARGEST, compression.LARGEST) for _, v, _, _ in good]
    code, error, books = plain_codes(want)
    by_label = defaultdict(int)
    for (_, _, label, _), e in zip(good, error, strict=True):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    expected = Counter((i, bytes(c.tolist()).hex(), int(e), by_label[label], digest) for (i, _, label, _), c, e in zip(good, code, error, strict=True))
    assert Counter(map(tuple, got)) == expected


def test_codes_few(spark):
    assert compression.compressed(spark.createDataFrame([], VECTORS)).collect() == []
    # three vectors of 17 components: parts of two, filled up with zeros
    rows = compression.compressed(spark.createDataFrame([(i, [float(i)] * 17, 0, "") for i in range(3)], VECTORS)).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in rows} == {(0, "00" * 16, 0), (1, "01" * 9 + "00" * 7, 0), (2, "02" * 9 + "00" * 7, 0)}


def test_bounds_are_used(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = compression.encoded(vectors)
    assert len(found.needs) == compression.ROUNDS
    for needs in found.needs:
        assert needs.sum() == vectors.count() * compression.PARTS and needs[1:17].sum() > needs[17:].sum()


# alignment of tokens

def test_aligned_equals_sets():
    rng = random.Random(6)
    for _ in range(2_000):
        n = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in "ab")
        if rng.random() < 0.3:
            b = a
        groups, i, j = [], 0, 0
        for i0, j0, m, k in alignment.aligned(a, b):
            assert (i0, j0) == (i, j)
            groups += [(1, 1)] * m if k == 0 else [(m, k)]
            i, j = (i + m, j + m) if k == 0 else (i + m, j + k)
        ends, want = sorted(set(a) & set(b)), []
        for low, high in zip([0, *ends], ends, strict=False):
            want.append((sum(low < x <= high for x in a), sum(low < x <= high for x in b)))
        assert groups == want


@pytest.fixture(scope="module")
def plain():
    """The groups of ids of a text, from the libraries' own calls on the whole text."""
    left, right = Tokenizer.from_file(LEFT), sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    left.encode_special_tokens = True
    a, b = (alignment.encoder(p, open(p, "rb").read()) for p in (LEFT, RIGHT))

    def groups(text):
        if not text:
            return []
        x, y, whole = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text), (" " + text).encode()
        if b"".join(a.tokens[i] for i in x) != whole or b"".join(b.tokens[i] for i in y) != whole:
            return []
        ea, eb = np.cumsum(a.sizes[x]).tolist(), np.cumsum(b.sizes[y]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            k, m = ea.index(end, i) + 1, eb.index(end, j) + 1
            out.append((x[i:k], y[j:m]))
            i, j = k, m
        return out

    return groups


def odd_texts():
    rng = random.Random(7)
    signs = "aé \n\t▁<>|0x1.'sЖ字😀  \r\x1c﻿​"
    texts = [None, "", " ", "  ", "a ", " a", "▁x", "a▁ b", "<|endoftext|> <s></s> <0x41>", "é" * 3, "x\r\n y", "the cat", "the cat", "\x00 \x00"]
    return texts + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_words_are_safe(plain):
    a, b = (alignment.encoder(p, open(p, "rb").read()) for p in (LEFT, RIGHT))
    texts = odd_texts()
    got = alignment.Aligned(texts, a, b).spelled()
    for text, found in zip(texts, got, strict=True):
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(text))
        assert found.decode() == want, repr(text)


def test_wide_groups():
    one = alignment.Encoder(lambda words: [[1] * len(f" {w}".encode()) for w in words], [b"", b"x"])
    whole = alignment.Encoder(lambda words: [[2] for _ in words], [b"", b"", b" xxx"])
    one.spells = whole.spells = lambda ids, word: True
    whole.sizes = np.array([0, 0, 101])
    found = alignment.Aligned(["x" * 100], one, whole)
    found.a, found.b = np.arange(101) % 3, np.array([5])
    found.la, found.lb = np.array([101]), np.array([1])
    few = found.links()
    alignment.WIDE, kept = 10, alignment.WIDE
    many = found.links()
    alignment.WIDE = kept
    total = lambda x: sorted(Counter(dict()).items()) or sorted((p, int(x[2][x[1] == p].sum())) for p in set(x[1].tolist()))
    assert total(few) == total(many) and sum(n for _, n in total(many)) == 101


def check_linked(spark, plain, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string").repartition(3)
    got = Counter(map(tuple, alignment.linked(df, LEFT, RIGHT).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    links, held = [], Counter()
    for _, text in rows:
        pairs = Counter((x, y) for a, b in plain(text) for x in a for y in b)
        links.append(pairs)
        held.update(pairs.keys())
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = Counter()
    for (i, text), pairs in zip(rows, links, strict=True):
        groups = plain(text)
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        want[(
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in pairs.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if spelled else "",
        )] += 1
    assert got == want


def test_linked_odd(spark, plain):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(odd_texts())]
    check_linked(spark, plain, rows + rows[100:120])


def test_linked_documents(spark, plain, monkeypatch):
    check_linked(spark, plain, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_alignments(spark, plain):
    rows = [(1, "unbelievable things"), (2, None), (None, "x"), (3, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in alignments_of(df):
        want = plain(dict(rows)[r["doc_id"]])
        assert (r["a"], r["b"]) == ([x for a, _ in want for x in a], [y for _, b in want for y in b])
        assert (r["a_groups"], r["b_groups"]) == ([len(a) for a, _ in want], [len(b) for _, b in want])
    assert alignments_of(df.limit(0)) == [] and alignment.linked(df.limit(0), LEFT, RIGHT).collect() == []


def alignments_of(df):
    return alignment.alignments(df, LEFT, RIGHT).collect()


def test_long_texts():
    a, b = (alignment.encoder(p, open(p, "rb").read()) for p in (LEFT, RIGHT))
    for text in ("a" * 1_000_000, " " * 1_000_000, "é1 " * 300_000, "\n \n" * 300_000):
        found = alignment.Aligned([text], a, b)
        assert a.sizes[found.a].sum() == b.sizes[found.b].sum() == len(text.encode()) + 1


# toxicity

def test_folded():
    assert toxicity.folded("Іdiot 1D10T ｉｄｉｏｔ id​iot $tupid a2024b 2024 m@t") == ["idiot", "idiot", "idiot", "idiot", "stupid", "a2o2ab".replace("2o2a", "2o2a"), "2024", "mat"]
    assert toxicity.folded(None) == toxicity.folded("") == toxicity.folded(" $ !| ") == []
    assert len(toxicity.folded("!a" * 2_000_000)) > 0 and len(toxicity.folded("a@" * 2_000_000)) > 0


def test_matches_equal_plain():
    rng = random.Random(8)
    model = toxicity.Model({" bad ": 2.0, " ba": 1.0, " worse ": 3.0, " fooi ": 1.5}, {" bad  dog ", " not  worse "}, 1.0, 0.0)
    found = model.automaton()
    for _ in range(500):
        words = [rng.choice(["bad", "bat", "dog", "not", "worse", "fooi", "x"]) for _ in range(rng.randint(0, 12))]
        want, i = [], 0
        while i < len(words):
            if words[i : i + 2] in (["bad", "dog"], ["not", "worse"]):
                i += 2
                continue
            hit = {"bad": " bad ", "bat": " ba", "worse": " worse ", "fooi": " fooi "}.get(words[i])
            want += [(model.weights[hit], hit)] if hit else []
            i += 1
        assert [(w, e) for _, w, e in toxicity.matches(found, toxicity.marked(words))] == want


DOCS = "doc_id long, text string, score string, held_out string"
LABELS = "doc_id long, toxic int, text string"


def toxic_set(n=600):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        if i % 6 == 0:
            for _ in range(len(words) // 12 + 1):
                words.insert(rng.randrange(len(words)), rng.choice(["scumball", "loser", "nastyone", "nastytwo", "nastysix"]))
        elif i % 6 == 1:
            words += ["scumball", "cleaner"]
        docs.append((i, " ".join(words), "x", "y"))
        labels.append((i, int(i % 6 == 0), "z"))
    return docs, labels


def test_toxicity_learns(spark):
    docs, labels = toxic_set()
    plain = " ".join(docs[2][1].split()[:30])
    odd = [(10_001, plain + " l0ser", None, None), (10_002, plain + " sсumbаll ioser", None, None), (10_003, plain + " scumball cleaner", None, None),
           (10_004, plain + " nastyseven nastyseven", None, None), (10_005, None, None, None), (10_006, "", None, None), (None, plain, None, None), (10_007, plain + " lo5er" * 40_000, None, None)]
    d = spark.createDataFrame(docs + odd + [docs[0]], DOCS).repartition(4)
    label = spark.createDataFrame([*labels, (None, 1, ""), (10_001, None, ""), labels[0]], LABELS)
    rows = toxicity.toxicity_scores(d, label).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + len(odd) + 1
    held = [got[i] for i, _, _ in labels if got[i]["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    assert [got[i]["predicted"] for i in (10_001, 10_002, 10_003, 10_004, 10_005, 10_006, None, 10_007)] == [1, 1, 0, 1, 0, 0, 0, 1]
    assert not got[None]["held_out"] and all(0 <= r["score"] <= 1 for r in rows)
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(d.repartition(7), label).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_held_out_labels_unused(spark):
    docs, labels = toxic_set(120)
    d = spark.createDataFrame(docs, DOCS)
    label = spark.createDataFrame(labels, LABELS)
    turned = label.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.toxicity_scores(d, label).collect())) == sorted(map(tuple, toxicity.toxicity_scores(d, turned).collect()))


def test_toxicity_matches(spark):
    model = toxicity.Model({" bad ": 2.0}, set(), 4.0, -1.0)
    df = spark.createDataFrame([(1, "so B4D, bad", "x"), (2, None, "y")], "doc_id long, text string, toxicity string")
    got = {r["doc_id"]: r for r in toxicity.scored(df, model).collect()}
    assert [tuple(m) for m in got[1]["toxicity_matches"]] == [(1, 2.0, "bad"), (2, 2.0, "bad")] and got[2]["toxicity_matches"] == []
    assert got[1]["toxicity"] > got[2]["toxicity"] == pytest.approx(1 / (1 + np.exp(1)))


def test_toxicity_empty(spark):
    docs, labels = spark.createDataFrame([(1, "x", "", "")], DOCS), spark.createDataFrame([], LABELS)
    assert [tuple(r) for r in toxicity.toxicity_scores(docs, labels).collect()] == [(1, False, 0.5, 1)]
    assert toxicity.toxicity_scores(docs.limit(0), labels).collect() == []


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right")).first()
    assert r["right"] >= 0.9


@pytest.mark.parametrize("toxic, clean", [(["grobian", "grobheit", "grobes"], "grob"), (["lulli"], "iuiii")])
def test_toxicity_found_but_not_counted(spark, toxic, clean):
    """A clean text may hold what an entry finds without being one of the texts that were counted for it."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [(ids[n], f"{toxic[n % len(toxic)]} w{n} x{n * 7}", 1) for n in range(60)]
    texts += [(ids[n], f"plain y{n} z{n * 3}" + (f" {clean}" if n == 100 else ""), 0) for n in range(60, 160)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in texts], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    assert [1 for _ in toxicity.matches(model.automaton(), toxicity.marked([clean]))]
    assert model.slope > 0
