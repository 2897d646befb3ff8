"""Toxicity: a weighted lexicon found by Aho-Corasick in folded texts.

Words are folded first: compatibility forms, look-alike letters of other scripts,
digits and signs that stand for letters inside a word, small letters. The lexicon is
learnt from labelled rows: whole words and beginnings of words that far more toxic
texts hold than clean ones, weighted by the logarithm of the ratio. Word pairs around
an entry that clean texts hold as often are exception phrases and count nothing; more
may be given. All patterns go into one automaton; of overlapping matches the leftmost
counts, of these the longest. The weights found are added up and divided by
the number of words to the power ``LENGTH_POWER``; a logistic curve makes that a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.llm.cuts import cut
from driftmap.llm.words import slices

THRESHOLD = 0.3
LENGTH_POWER = 0.75
#: About so many labelled rows are learnt from at most, by a hash of their id.
SAMPLE_ROWS = 20_000
#: Signs of a beginning of a word that can be an entry.
BEGINNINGS = range(3, 9)
#: Toxic texts an entry is in at least, its least weight, and the least root of its likelihood ratio (as many standard errors).
LEAST_TEXTS, LEAST_WEIGHT, LEAST_ERRORS = 3, 1.0, 4.5
#: A beginning stands for more than one word: so many times the texts of its longest extension hold it.
WIDER = 1.2
#: Clean texts an exception phrase is in at least.
LEAST_EXCEPTIONS = 3

# Letters of other scripts that look like these Latin ones.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κк", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "τт", "u": "υս", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ",
    "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
# Digits and signs written for letters.
FOR_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
# Signs without width.
NO_WIDTH = "­​‌‍⁠﻿"

_LOOKS = str.maketrans({x: letter for letter, others in LOOK_ALIKES.items() for x in others} | dict.fromkeys(NO_WIDTH))
_LETTERS = str.maketrans(FOR_LETTERS)
#: A word: letters and digits, with signs for letters only in front of a letter or digit.
_WORD = re.compile(r"[@$]?[^\W_](?:[^\W_]|[@$!|](?=[^\W_]))*")
_DISGUISED = re.compile(r"[013457@$!|]")
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def folded(text: str | None) -> list[str]:
    """The words of a whole text, folded; a word without any letter keeps its digits."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_LOOKS)
    found = _WORD.findall(text.lower())
    return [w.translate(_LETTERS) if _DISGUISED.search(w) and _LETTER.search(w) else w for w in found]


def marked(words: list[str]) -> str:
    """Each word between two blanks, so that entries can name both of a word's ends."""
    return " " + "  ".join(words) + " " if words else ""


def entries_of(word: str) -> list[str]:
    """What a word could be found by: itself, or its beginnings."""
    return [f" {word} ", *[" " + word[:n] for n in BEGINNINGS if n < len(word)]]


@dataclass
class Model:
    """Weights of entries (marked words or beginnings), phrases that count nothing (marked), and the curve."""

    weights: dict[str, float]
    exceptions: set[str]
    slope: float
    offset: float

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight, entry))
            # the sign 1 is folded to i, but may stand for l as well
            if entry.endswith(" ") and "l" in entry and entry.replace("l", "i") not in self.weights:
                found.add_word(entry.replace("l", "i"), (len(entry), weight, entry))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0, phrase))
        if len(found):
            found.make_automaton()
        return found

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = self.slope * total / np.maximum(words, 1) ** LENGTH_POWER + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def matches(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, float, str]]:
    """(start, weight, entry) of the matches in a marked text that count: leftmost, then longest, none overlapping."""
    if not len(automaton):
        return
    found = sorted((end + 1 - size, -size, weight, entry) for end, (size, weight, entry) in automaton.iter(text))
    free = 0
    for start, size, weight, entry in found:
        if start >= free:
            free = start - size
            if weight:
                yield start, weight, entry


def _weight(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1) * (n_clean + 1) / (clean + 0.5))


def _key(words: list[str]) -> int:
    """Equal for most near copies: the smallest hash of five words in a row."""
    n = max(1, len(words) - 4)
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(n)) >> 1


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text): marked texts of labelled rows outside the held-out fold, one of each group of copies.

    At most about ``SAMPLE_ROWS`` rows. Of a document labelled twice the higher label counts.
    """
    usable = cut(
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, SAMPLE_ROWS / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def fold(batches):
        for batch in batches:
            for part in slices(batch):
                words = [folded(t) for t in part.column("text").to_pylist()]
                arrays = [part.column("doc_id"), part.column("toxic"), pa.array([_key(w) for w in words], pa.int64()), pa.array([marked(w) for w in words], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "toxic", "key", "text"])

    # about SAMPLE_ROWS short rows, so one side of this join is small whatever the input
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select("doc_id", F.col("toxic").cast("int"))), "doc_id")
    rows = cut(rows.mapInArrow(fold, "doc_id long, toxic int, key long, text string"))
    first = rows.groupBy("toxic", "key").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.lit(1))
    return rows.join(F.broadcast(first.select("doc_id")), "doc_id").select("doc_id", "toxic", "text")


def _texts_with(rows: DataFrame, find) -> DataFrame:
    """(entry, n): in how many texts ``find`` (text to entries) finds an entry."""

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                n = Counter(e for text in part.column("text").to_pylist() for e in set(find(text)))
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["entry", "n"])

    return rows.select("text").mapInArrow(count, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _all_entries(text: str) -> set[str]:
    return {e for w in set(text.split()) for e in entries_of(w)}


def lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries with their weights from the numbers of texts that hold them."""
    found = {}
    for entry, n in toxic.items():
        other = clean.get(entry, 0)
        weight = _weight(n, other, n_toxic, n_clean)
        expected = (n + other) * n_toxic / (n_toxic + n_clean)
        ratio = n * math.log(n / expected) + (other and other * math.log(other / (n + other - expected)))
        if weight >= LEAST_WEIGHT and 2 * ratio >= LEAST_ERRORS**2:
            found[entry] = weight
    # a beginning that stands for one longer entry only says nothing of its own
    longest: dict[str, int] = {}
    for entry in found:
        for n in BEGINNINGS:
            if n + 1 < len(entry):
                longest[entry[: n + 1]] = max(longest.get(entry[: n + 1], 0), toxic[entry])
    return {e: w for e, w in found.items() if e.endswith(" ") or toxic[e] >= WIDER * longest.get(e, 0)}


def _phrases(text: str, automaton: ahocorasick.Automaton) -> Iterator[str]:
    """Entries found, each with the word before or behind it (whole words), as patterns."""
    for start, _, _entry in matches(automaton, text):
        end = text.index(" ", start + 1) + 1
        if start:
            yield text[text.rindex(" ", 0, start - 1) : end]
        if end < len(text):
            yield text[start : text.index(" ", end + 1) + 1]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's steps, held slightly towards 0."""
    at, b = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ b, -35, 35)))
        step = np.linalg.solve((at * (p * (1 - p))[:, None]).T @ at + 1e-3 * np.eye(2), at.T @ (y - p) - 1e-3 * b)
        b += np.clip(step, -5, 5)
    return float(b[0]), float(b[1])


def learned(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Model:
    """The model of labelled texts; without any it gives 0.5 to all.

    ``exceptions`` are phrases beyond those that are learnt. The curve is fitted to the
    sample with every text's own share taken out of the weights of entries it was counted for.
    """
    spark = docs.sparkSession
    rows = cut(sample(docs, labels))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sum(n for k, n in sizes.items() if k), sizes.get(0, 0)
    given = {marked(folded(p)) for p in exceptions} - {""}
    # what the driver holds is bounded by the texts of SAMPLE_ROWS rows
    toxic = {r["entry"]: r["n"] for r in _texts_with(rows.where("toxic <> 0"), _all_entries).where(F.col("n") >= LEAST_TEXTS).collect()}
    known = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r["entry"]: r["n"] for r in _texts_with(rows.where("toxic = 0"), lambda text: _all_entries(text) & known.value).collect()}
    model = Model(lexicon(toxic, clean, n_toxic, n_clean), given, 0.0, 0.0)
    sent = spark.sparkContext.broadcast(model)
    around = []
    for kind in ("toxic <> 0", "toxic = 0"):

        def phrases(text, cache=[]):  # noqa: B006 - one automaton a worker
            cache or cache.append(sent.value.automaton())
            return _phrases(text, cache[0])

        around.append({r["entry"]: r["n"] for r in _texts_with(rows.where(kind), phrases).where(F.col("n") >= LEAST_EXCEPTIONS).collect()})
    model.exceptions |= {p for p, n in around[1].items() if _weight(around[0].get(p, 0), n, n_toxic, n_clean) < 0}
    shares = {e: (toxic[e], clean.get(e, 0)) for e in model.weights}
    sent = spark.sparkContext.broadcast((model, shares))

    def strip_own(batches):
        model, shares = sent.value
        automaton = model.automaton()
        for batch in batches:
            x = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                total, own = 0.0, _all_entries(text)
                for entry, n in Counter(entry for _, _, entry in matches(automaton, text)).items():
                    a, b = shares[entry]
                    # a beginning that is a whole word here, or an l read as i, is found but was not counted
                    if entry in own:
                        a, b = a - bool(label), b - (not label)
                    total += n * max(0.0, _weight(a, b, n_toxic, n_clean))
                x.append(total / max(1, text.count(" ") // 2) ** LENGTH_POWER)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("toxic")], names=["x", "toxic"])

    # two numbers for each row of the sample
    points = rows.select("text", "toxic").mapInArrow(strip_own, "x double, toxic int").toArrow()
    if points.num_rows:
        at = np.lexsort((points["toxic"].to_numpy(), points["x"].to_numpy()))
        model.slope, model.offset = _curve(points["x"].to_numpy()[at], (points["toxic"].to_numpy()[at] != 0).astype(float))
    return model


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs``, the score of each row's whole ``text`` as ``name``, and ``<name>_matches``.

    Matches are (word, weight, entry): the number of the first word, from 0, and what
    was found there. Columns of these names are replaced. Null and empty texts score
    what a text without matches does. An empty table gives no rows.
    """
    more = f"{name}_matches"
    docs = docs.drop(name, more)
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField("word", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("entry", T.StringType())]))
    arrow = pa.list_(pa.struct([("word", pa.int32()), ("weight", pa.float64()), ("entry", pa.string())]))

    def score(batches):
        automaton = known.value.automaton()
        for batch in batches:
            for part in slices(batch):
                totals, counts, found = [], [], []
                for text in part.column("text").to_pylist():
                    words = folded(text)
                    text = marked(words)
                    hits = [(text.count(" ", 0, start) // 2, weight, entry.strip()) for start, weight, entry in matches(automaton, text)]
                    totals.append(math.fsum(h[1] for h in hits))
                    counts.append(len(words))
                    found.append([dict(zip(("word", "weight", "entry"), h, strict=True)) for h in hits])
                scores = known.value.score(np.array(totals), np.array(counts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array(found, arrow)], names=[*part.schema.names, name, more])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(more, kind)]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic (0 or 1); only rows outside the held-out fold are
    learnt from, and the score is that of the text alone. Rows without doc_id are not held out.
    """
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    rows = scored(docs, learned(docs, labels, exceptions), "score")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
