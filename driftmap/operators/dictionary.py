"""Keywords of any number found in texts, by an index of their rarest q-grams.

A keyword is posted under one q-gram: that of its own that is rarest. Texts are cut into
overlapping blocks, whose q-grams look the index up in an equi-join; whatever meets is tested
exactly. No text meets a keyword it shares no q-gram with. The plan doesn't grow with the
dictionary beyond ``KNOWN`` q-grams: so many are looked for by one pattern, of more all of a text are looked up. ``functions.keywords`` is the form for small fixed dictionaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.functions.text import computed
from driftmap.session import shared_dir

GRAM, BLOCK = 4, 256
#: Of the texts, one in so many is counted to learn which q-grams are rare; results don't depend on it.
COUNTED = 64
#: Q-grams of an index that texts are searched for by a pattern.
KNOWN = 4_096
#: Rows of an index that are sent to every executor. Its files say little about its size in memory.
SENT_ROWS = 200_000


def _one_of(grams: list[str]) -> str:
    """A pattern of texts of the same length, as a tree of their beginnings."""
    after: dict[str, list[str]] = {}
    for gram in sorted(grams):
        after.setdefault(gram[:1], []).append(gram[1:])
    last = all(rest == [""] for rest in after.values())
    signs = {c: c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in after}
    if last:
        return f"[{''.join(signs.values())}]"
    return f"(?:{'|'.join(signs[c] + _one_of(rest) for c, rest in after.items())})"


def _grams(text: Column, n: int, known: list[str] | None = None) -> Column:
    """All parts of n characters, in order, or those of them that are ``known``."""
    part = f".{{{n}}}" if known is None else _one_of(known) if known else "(?!)"
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({part}))."), F.lit(1))


def _blocks(text: str, reach: int) -> Column:
    """Parts of ``BLOCK`` characters or more with the next reach - 1 characters, so that each place of a word lies in one."""
    size = max(BLOCK, reach)
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size + reach - 1}}})).{{1,{size}}}"), F.lit(1))


def keyword_index(words: DataFrame, texts: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """(words with their gram, length of the longest, lengths of grams), written to the shared folder.

    ``words`` has the column word, ``texts`` the column text. Empty and null words find nothing.
    """
    spark = words.sparkSession
    base = shared_dir(spark, "keywords")
    words.where("word <> ''").distinct().write.parquet(f"{base}/words")
    stored = spark.read.parquet(f"{base}/words")
    size = F.least(F.length("word"), F.lit(GRAM))
    sizes = stored.groupBy(size.alias("n")).agg(F.max(F.length("word")).alias("reach")).collect()  # one row a length of grams
    lengths = sorted(r["n"] for r in sizes)
    parts = F.lit(None).cast("array<string>")
    for n in lengths:
        parts = F.when(size == n, _grams(F.col("word"), n)).otherwise(parts)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0)
    seen = some.select(F.explode(_blocks("text", 1)).alias("block")).select(F.explode(_grams(F.col("block"), GRAM)).alias("gram")).groupBy("gram").count()
    posted = stored.select("*", F.posexplode(parts).alias("at", "gram")).join(seen, "gram", "left")
    rarest = F.min_by(F.struct("gram"), F.struct(F.coalesce("count", F.lit(0)), "at")).alias("g")
    posted.groupBy(*stored.columns).agg(rarest).select(*stored.columns, "g.gram").write.parquet(f"{base}/index")
    return spark.read.parquet(f"{base}/index"), max((r["reach"] for r in sizes), default=1), lengths


def contained(texts: DataFrame, words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs of a text and a word inside it, each once: the columns of ``texts`` but text, and those of ``words``.

    ``texts`` has the column text, ``words`` the column word; both have the columns of
    ``by``, which must be equal (nulls are not). Case counts: lower both sides if it shall not.
    """
    by = by or []
    index, reach, lengths = keyword_index(words, texts)
    few = [r["gram"] for r in index.select("gram").distinct().limit(KNOWN + 1).collect()]
    known = {n: [g for g in few if len(g) == n] if len(few) <= KNOWN else None for n in lengths}
    grams = F.flatten(F.array(*[_grams(F.col("block"), n, known[n]) for n in lengths])) if lengths else F.array().cast("array<string>")
    named = [c for c in texts.columns if c != "text"]
    # few files or few long texts may hold all blocks, so these are dealt first
    blocks = texts.select(*named, _blocks("text", reach).alias("blocks")).select(*named, F.explode(computed("blocks")).alias("block")).repartition(*named, "block")
    looked = blocks.select(*named, "block", F.array_distinct(grams).alias("grams")).select(*named, "block", F.explode(computed("grams")).alias("gram"))
    many = index.limit(SENT_ROWS + 1).count() > SENT_ROWS
    found = looked.join(index.hint("merge") if many else index, [*by, "gram"]).where(F.col("block").contains(F.col("word")))
    return found.select(*named, *[c for c in words.columns if c not in by]).distinct()


def dictionary_tags(texts: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, tags): the words of (word, step) inside each text, case ignored, and their steps, sorted; texts without any are left out."""
    lowered = texts.select(key, F.lower("text").alias("text"))
    pairs = contained(lowered, words.select(F.lower("word").alias("word"), "step"))
    tags = pairs.select(key, F.explode(F.array("word", "step")).alias("tag")).where("tag IS NOT NULL")
    return tags.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
