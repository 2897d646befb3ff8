"""Tokens of two tokenizers over the same bytes, aligned by skipping along the diagonal.

Each text is encoded twice, as a space and the text. The ends of tokens are byte
offsets; where both tokenizers end a token, a group ends. As long as the ends agree at
the present shift between the two indexes, groups are one to one: windows of 1, 2, 4,
... ends are compared until one differs, and its halves find the last that agrees.
The irregular group behind it is walked token by token, which gives the next shift.

Texts go through in slices of about ``SLICE_BYTES``. A slice encodes each of its
distinct words once, and names each of its distinct pairs of linked ids once, whatever
the number of documents and links. So the shuffle that adds up how many documents of
the corpus hold a pair gets at most one row a slice and pair: no pair is hot.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from driftmap.llm.cuts import cut
from driftmap.llm.words import slices
from driftmap.session import shared_dir

SLICE_BYTES = 4 << 20
#: Links of one group from which equal ids of the group are counted before they are paired.
WIDE = 4_096
#: Words whose bytes are compared at once; only if they differ is each of them looked at.
CHECKED = 512
#: Signs of a word beyond which the slower library encodes it: the fast one gives up on long runs of blanks.
LONG = 50_000

# Fixed value: how byte-level vocabularies cut texts before merging.
BYTE_LEVEL_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPACE = "▁"
#: A cut before a blank is safe for both kinds if what stands before it is neither white space nor the sign for one.
_CUT = re.compile(f"(?<=[^\\s{SPACE}])(?= )")
_UNSAFE = re.compile(f"[\\s{SPACE}] ")


@dataclass
class Encoder:
    """``encode`` takes words and gives the ids of a space and each word; ``tokens[i]`` are the bytes of id i."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(t) for t in self.tokens], np.int64)

    def spells(self, ids: list[int], word: str) -> bool:
        return b"".join([self.tokens[i] for i in ids]) == b" " + word.encode()


def byte_level(raw: bytes) -> Encoder:
    """Byte-level BPE from a tokenizer's JSON whose ids are in the order of its merges.

    Added tokens are left out, so their strings are plain text.
    """
    spec = json.loads(raw)
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    before = spec.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("not a plain byte-level tokenizer")
    joined = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if joined != sorted(joined):
        raise ValueError("the ids are not in the order of the merges")
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in added}
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    own = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_CUTS, mergeable_ranks=ranks, special_tokens={})
    plain: list[Tokenizer] = []

    def encode_long(word: str) -> list[int]:
        if not plain:
            plain.append(Tokenizer.from_str(raw.decode()))
            plain[0].encode_special_tokens = True
        return plain[0].encode(" " + word, add_special_tokens=False).ids

    return Encoder(lambda words: [own.encode_ordinary(" " + w) if len(w) <= LONG else encode_long(w) for w in words], tokens)


def piece_model(raw: bytes) -> Encoder:
    """A sentencepiece model that adds the space itself and has no piece with a space behind another sign."""
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids]
    if any(SPACE in p.lstrip(SPACE) for p in pieces) or model.encode("a", out_type=str)[:1] not in ([SPACE + "a"], [SPACE]):
        raise ValueError("pieces reach over the ends of words, or no space is added")
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(ids, pieces, strict=True)]
    lone = [model.piece_to_id(SPACE)]
    return Encoder(lambda words: [ids or lone for ids in model.encode(words, num_threads=1)], tokens)


def encoder(name: str, raw: bytes) -> Encoder:
    return piece_model(raw) if name.endswith(".model") else byte_level(raw)


def cut_words(text: str) -> list[str]:
    """Parts whose tokens don't depend on their neighbours, without the space that starts each of them."""
    text = " " + text
    if _UNSAFE.search(text):
        return [part[1:] for part in _CUT.split(text)]
    return text[1:].split(" ")


def aligned(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches (i, j, n, 0): n one-to-one groups from tokens i and j on, and (i, j, m, n): one group of m and n tokens.

    ``a`` and ``b`` are rising ends of tokens, the last of both the same.
    """
    i, j, size = 0, 0, len(a)
    while i < size:
        if a[i] == b[j]:
            shift, at, width = j - i, i + 1, 1
            while at < size and a[at : at + width] == b[at + shift : at + shift + width]:
                at, width = at + width, 2 * width
            if at > size:
                at = size
            while at < size and width > 1:
                width //= 2
                if a[at : at + width] == b[at + shift : at + shift + width]:
                    at += width
            yield i, j, at - i, 0
            i, j = at, at + shift
        else:
            m, n = i, j
            while a[m] != b[n]:
                if a[m] < b[n]:
                    m += 1
                else:
                    n += 1
            yield i, j, m + 1 - i, n + 1 - j
            i, j = m + 1, n + 1


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


class Aligned:
    """All groups of a slice of texts.

    ``a`` and ``b`` are the ids of the whole slice, ``a_at[d]`` and ``b_at[d]`` the
    first of text d. ``ga[g]`` and ``gb[g]`` are the first tokens of group g, ``g_at[d]`` the
    first group of text d. Texts that are null, empty or not spelled out by both
    tokenizers' bytes have no tokens.
    """

    def __init__(self, texts: list[str | None], left: Encoder, right: Encoder):
        codes: dict[str, int] = {}
        words = [[codes.setdefault(w, len(codes)) for w in cut_words(t)] if t else [] for t in texts]
        per_text = np.array([len(w) for w in words], np.int64)
        used = np.fromiter(chain.from_iterable(words), np.int64, int(per_text.sum()))
        del words
        distinct = list(codes)
        spelled = np.ones(len(distinct), bool)
        flat = []
        for side in (left, right):
            ids = side.encode(distinct) if distinct else []
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append((np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts, _starts(counts)))
            for at in range(0, len(distinct), CHECKED):
                some = slice(at, at + CHECKED)
                if b"".join(map(side.tokens.__getitem__, chain.from_iterable(ids[some]))) != (" " + " ".join(distinct[some])).encode():
                    spelled[some] &= [side.spells(part, word) for part, word in zip(ids[some], distinct[some], strict=True)]
        whole = np.ones(len(texts), bool)
        whole[np.repeat(np.arange(len(texts)), per_text)[~spelled[used]]] = False
        used = used[np.repeat(whole, per_text)]
        per_text = np.where(whole, per_text, 0)
        word_at = _starts(per_text)
        sides = []
        for (ids, counts, starts), side in zip(flat, (left, right), strict=True):
            tokens = ids[_ranges(starts[used], counts[used])]
            sides.append((tokens, _starts(counts[used])[word_at], np.cumsum(side.sizes[tokens])))
        (self.a, self.a_at, a_ends), (self.b, self.b_at, b_ends) = sides
        found: list[int] = []
        stretch_at = [0]
        for i, k, j, l in zip(self.a_at[:-1], self.a_at[1:], self.b_at[:-1], self.b_at[1:], strict=True):
            found.extend(chain.from_iterable(aligned(a_ends[i:k].tolist(), b_ends[j:l].tolist())))
            stretch_at.append(len(found) // 4)
        i, j, m, n = np.array(found, np.int64).reshape(-1, 4).T
        stretches = np.diff(stretch_at)
        groups = np.where(n == 0, m, 1)
        self.ga, self.gb = _ranges(i + np.repeat(self.a_at[:-1], stretches), groups), _ranges(j + np.repeat(self.b_at[:-1], stretches), groups)
        self.g_at = _starts(groups)[stretch_at]
        self.la = np.diff(self.ga, append=len(self.a))
        self.lb = np.diff(self.gb, append=len(self.b))

    def text_of_groups(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.g_at) - 1), np.diff(self.g_at))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): linked occurrences, pair being id of a * 2^32 + id of b; a (text, pair) may come more than once."""
        product, text = self.la * self.lb, self.text_of_groups()
        few = np.flatnonzero(product < WIDE)
        which = np.repeat(few, product[few])
        k = _ranges(np.zeros(len(few), np.int64), product[few])
        pairs = [(self.a[self.ga[which] + k // self.lb[which]] << 32) | self.b[self.gb[which] + k % self.lb[which]]]
        texts, times = [text[which]], [np.ones(len(which), np.int64)]
        for g in np.flatnonzero(product >= WIDE):
            x, nx = np.unique(self.a[self.ga[g] : self.ga[g] + self.la[g]], return_counts=True)
            y, ny = np.unique(self.b[self.gb[g] : self.gb[g] + self.lb[g]], return_counts=True)
            pairs.append(((x[:, None] << 32) | y).ravel())
            times.append((nx[:, None] * ny).ravel())
            texts.append(np.full(len(pairs[-1]), text[g]))
        return np.concatenate(texts), np.concatenate(pairs), np.concatenate(times)

    def spelled(self) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        top = int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1
        written = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(top)]
        out = np.zeros(len(self.a) + len(self.b), np.int64)
        group_a, group_b = np.repeat(self.gb, self.la), np.repeat(self.ga + self.la, self.lb)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.ga + self.la - 1], last_b[self.gb + self.lb - 1] = top, 2 * top
        out[np.arange(len(self.a)) + group_a] = self.a + last_a
        out[np.arange(len(self.b)) + group_b] = self.b + last_b
        at = (self.a_at + self.b_at).tolist()
        return [b"".join([written[x] for x in out[i:j].tolist()])[:-1] for i, j in zip(at[:-1], at[1:], strict=True)]


def _raw(spark: SparkSession, path: str) -> bytes:
    """A tokenizer's file (a few MB), read through Spark; workers get its bytes."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def _workers(spark: SparkSession, paths: tuple[str, str]) -> Callable[[], tuple[Encoder, Encoder]]:
    files = spark.sparkContext.broadcast([(p, _raw(spark, p)) for p in paths])
    return lambda: tuple(encoder(name, raw) for name, raw in files.value)


def alignments(docs: DataFrame, left: str, right: str) -> DataFrame:
    """(doc_id, a, b, a_groups, b_groups): the ids of both tokenizers, and how many of each fall into each group.

    One row per row of ``docs`` (doc_id, text); other columns are not read. Texts that
    are null, empty or that one of the tokenizers doesn't spell out again have empty
    lists. ``left`` and ``right`` are files of tokenizers: a byte-level JSON or a
    sentencepiece ``.model``.
    """
    encoders = _workers(docs.sparkSession, (left, right))

    def run(batches):
        a, b = encoders()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                s = Aligned(part.column("text").to_pylist(), a, b)
                lists = [(s.a_at, s.a), (s.b_at, s.b), (s.g_at, s.la), (s.g_at, s.lb)]
                columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for at, x in lists]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "a", "b", "a_groups", "b_groups"])

    kind = T.ArrayType(T.IntegerType())
    fields = [docs.schema["doc_id"], *[T.StructField(c, kind) for c in ("a", "b", "a_groups", "b_groups")]]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: A slice's rows: one a document (``pairs`` and ``times`` are its distinct pairs as numbers of the slice), one a pair.
_PART = f"slice long, {_DOC}, pairs binary, times binary, pair int, a int, b int, docs long"


def _rows(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_ARROW = pa.schema([
    ("slice", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()),
])


def _slice_rows(number: int, part: pa.RecordBatch, s: Aligned) -> Iterator[pa.RecordBatch]:
    n = part.num_rows
    text, pair, times = s.links()
    distinct, code = np.unique(pair, return_inverse=True)
    width = max(1, len(distinct))
    held, back = np.unique(text * width + code, return_inverse=True)
    total = np.bincount(back, times, len(held)).astype(np.int64) if len(held) else np.zeros(0, np.int64)
    holder, code = held // width, held % width
    at = np.searchsorted(holder, np.arange(n + 1))
    hashes = [hashlib.sha256(x).hexdigest() if x else "" for x in s.spelled()]
    yield _rows({
        "slice": pa.array(np.full(n, number)), "doc_id": part.column("doc_id"),
        "n_a": pa.array(np.diff(s.a_at)), "n_b": pa.array(np.diff(s.b_at)), "n_groups": pa.array(np.diff(s.g_at)),
        "n_links": pa.array(np.diff(_starts(total)[at])), "groups_sha256": pa.array(hashes),
        "pairs": pa.array([np.diff(code[i:j], prepend=0).astype("<u4").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        "times": pa.array([total[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
    }, n, _ARROW)
    if len(distinct):
        yield _rows({
            "slice": pa.array(np.full(len(distinct), number)), "pair": pa.array(np.arange(len(distinct))),
            "a": pa.array(distinct >> 32), "b": pa.array(distinct & 0xFFFFFFFF), "docs": pa.array(np.bincount(code, minlength=len(distinct))),
        }, len(distinct), _ARROW)


def _finished(table: pa.Table) -> pa.Table:
    """The documents of one slice with the corpus counts of their links looked up by the slice's numbers."""
    known = table.filter(table["pair"].is_valid())
    counts, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, bool)
    at = known["pair"].to_numpy()
    counts[at], best[at] = known["docs"].to_numpy(), known["best"].to_numpy().astype(bool)
    docs = table.filter(table["pair"].is_null())
    n_best, count_sum = [], []
    for pairs, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist(), strict=True):
        code, n = np.cumsum(np.frombuffer(pairs, "<u4").astype(np.int64)), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(n[best[code]].sum()))
        count_sum.append(int((n * counts[code]).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def link_counts(docs: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """(parts, totals): a row a document and a row a distinct pair of each slice, and (a, b, n): the documents that hold a linked pair.

    Both are written to the shared folder and read from there.
    """
    spark = docs.sparkSession
    encoders = _workers(spark, (left, right))

    def run(batches):
        a, b = encoders()
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield from _slice_rows((task << 32) + number, part, Aligned(part.column("text").to_pylist(), a, b))
                number += 1

    folder = shared_dir(spark, "alignment")
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PART)
    rows.write.option("compression", "zstd").parquet(folder)
    parts = spark.read.parquet(folder)
    totals = cut(parts.where("pair IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("n")))
    return parts, totals


def linked(docs: DataFrame, left: str, right: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs`` (doc_id, text).

    See ``alignments`` for the texts without tokens: they have zeros and an empty
    ``groups_sha256``. ``n_best`` are the links whose pair is held by as many documents
    as any pair of its left id, ``count_sum`` adds up the pairs' documents over all
    links. A repeated row is a document of its own, a null doc_id stays null, an empty table gives no rows.
    """
    parts, totals = link_counts(docs, left, right)
    # one row for each id of the left vocabulary at most
    top = totals.groupBy("a").agg(F.max("n").alias("top"))
    looked_up = (
        parts.where("pair IS NOT NULL").select("slice", "pair", "a", "b")
        .join(totals, ["a", "b"]).join(F.broadcast(top), "a")
        .select("slice", "pair", F.col("n").alias("docs"), (F.col("n") == F.col("top")).alias("best"))
    )
    documents = parts.where("pair IS NULL").drop("pair", "a", "b", "docs")
    both = documents.unionByName(looked_up, allowMissingColumns=True)
    return both.groupBy("slice").applyInArrow(
        _finished, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
