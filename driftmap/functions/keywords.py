"""The step dictionary, applied as literal expressions so no join is planned."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Step -> words that point at it. Pass another mapping to extend it.
STEP_KEYWORDS: dict[str, list[str]] = {
    "chunking": ["chunk", "split", "textsplitter", "chunk_size", "chunk_overlap"],
    "embedding": ["embedding", "embed", "openai", "model", "text-embedding"],
    "storage": ["bucket", "gcs", "storage", "upload", "download"],
    "cache": ["pickle", "pkl", "cache", "dump", "load"],
    "vectordb": ["pinecone", "turbopuffer", "weaviate", "upsert", "namespace", "index"],
    "database": ["firestore", "mongodb", "collection", "document"],
    "ingestion": ["ingest", "read", "load", "source", "input"],
    "processing": ["process", "transform", "parse"],
}

# Settings in diff text that point at a step.
DIFF_STEP_PATTERNS: list[tuple[str, str]] = [
    (r"chunk_size\s*=\s*(\d+)", "chunking"),
    (r"chunk_overlap\s*=\s*(\d+)", "chunking"),
    (r"""model\s*=\s*["']([^"']+)["']""", "embedding"),
    (r"""namespace\s*=\s*["']([^"']+)["']""", "vectordb"),
    (r"""bucket\s*=\s*["']([^"']+)["']""", "storage"),
]

# Call arguments naming one of these are kept in full.
CONFIG_WORDS = [
    "chunk_size", "chunk_overlap", "model", "namespace", "index", "bucket", "path",
    "alias", "collection", "database", "pkl", "pickle", "cache", "embedding",
]

# File names that start a program, per language.
ENTRY_POINTS: dict[str, list[str]] = {
    "python": ["main.py", "app.py", "__main__.py", "run.py", "pipeline.py"],
    "javascript": ["index.js", "app.js", "main.js", "server.js"],
    "typescript": ["index.ts", "app.ts", "main.ts", "server.ts"],
    "java": ["Main.java", "App.java", "Application.java"],
}


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, (text.contains(w) for w in words), F.lit(False))


def _present(options: list[Column]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*options))))


def with_keyword_tags(
    df: DataFrame, text: str, out: str = "tags", steps: dict[str, list[str]] = STEP_KEYWORDS
) -> DataFrame:
    """Add every word found in a text column, and the steps those words belong to.

    The text is lowered once and searched once per word; steps follow from the
    words found.
    """
    words = sorted({w for ws in steps.values() for w in ws})
    low, found = F.col("_low"), F.col("_found")
    of_steps = [
        F.when(F.arrays_overlap(found, F.array(*[F.lit(w) for w in ws])), F.lit(step)) for step, ws in steps.items()
    ]
    return (
        df.withColumn("_low", F.lower(text))
        .withColumn("_found", F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words])))
        .withColumn(out, F.array_sort(F.array_union(found, F.array_compact(F.array(*of_steps)))))
        .drop("_low", "_found")
    )


def steps_named_in(text: Column, steps: dict[str, list[str]] = STEP_KEYWORDS) -> Column:
    """Steps with at least one of their words inside the text."""
    low = F.lower(text)
    return _present([F.when(contains_any(low, ws), F.lit(step)) for step, ws in steps.items()])


def steps_of_component(component: Column, steps: dict[str, list[str]] = STEP_KEYWORDS) -> Column:
    """Steps whose word list has the component itself, or whose name is inside it."""
    low = F.lower(component)
    return _present(
        [F.when(low.isin(ws) | low.contains(step), F.lit(step)) for step, ws in steps.items()]
    )


def steps_in_diff(diff_text: Column) -> Column:
    """Steps that a setting changed in raw diff text points at."""
    return _present([F.when(diff_text.rlike("(?i)" + p), F.lit(step)) for p, step in DIFF_STEP_PATTERNS])


def has_config_word(low: Column) -> Column:
    """Whether a text in small letters names a setting. It is looked at once per word, so hand in a column, not an expression."""
    return contains_any(low, CONFIG_WORDS)


def is_config_call(arg_text: Column) -> Column:
    return has_config_word(F.lower(arg_text))


def is_log_call(callee: Column) -> Column:
    return callee.contains("log") | callee.contains("print")
