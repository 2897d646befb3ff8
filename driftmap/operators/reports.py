"""Structure, entry point, token and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from driftmap.functions.text import start_of

from driftmap.functions.keywords import ENTRY_POINTS
from driftmap.functions.text import count_bracket_nodes, count_numbered_steps
from driftmap.sources.tree import base_name, directory, extension, prune_hidden

TOP_DIRECTORIES = 20
CHARS_PER_TOKEN = 4


def file_types(files: DataFrame) -> DataFrame:
    """(repo_id, ext, files): files per extension; files without one are left out."""
    return (
        prune_hidden(files)
        .select("repo_id", extension(F.col("path")).alias("ext"))
        .filter(F.col("ext") != "")
        .groupBy("repo_id", "ext")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def all_directories(files: DataFrame) -> DataFrame:
    """Distinct (repo_id, dir): each directory with its parents, down to the first hidden one."""
    hidden = F.array_position(F.transform("parts", lambda p: p.startswith(".")), True).cast("int")
    depth = F.when(hidden > 0, hidden - 1).otherwise(F.size("parts"))
    prefixes = F.transform(
        F.slice("parts", 1, F.col("depth")), lambda _, i: F.array_join(F.slice("parts", 1, i + 1), "/")
    )
    return (
        files.select("repo_id", directory(F.col("path")).alias("dir"))
        .filter(F.col("dir") != "")
        .distinct()
        .select("repo_id", F.split("dir", "/").alias("parts"))
        .withColumn("depth", depth)
        .select("repo_id", F.explode(prefixes).alias("dir"))
        .distinct()
    )


def structure(files: DataFrame) -> DataFrame:
    """(repo_id, total_files, total_dirs)."""
    totals = prune_hidden(files).groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
    dirs = all_directories(files).groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_dirs"))
    return totals.join(dirs, "repo_id", "left").select(
        "repo_id", "total_files", F.coalesce("total_dirs", F.lit(0)).alias("total_dirs")
    )


def top_dirs(files: DataFrame, limit: int = TOP_DIRECTORIES) -> DataFrame:
    """(repo_id, rank, dir): the first directories by name.

    The rank filter lets Spark keep only ``limit`` rows per repository on each
    side of the shuffle.
    """
    by_name = Window.partitionBy("repo_id").orderBy("dir")
    return (
        all_directories(files)
        .withColumn("rank", F.row_number().over(by_name))
        .filter(F.col("rank") <= limit)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def entry_points(files: DataFrame, names: dict[str, list[str]] = ENTRY_POINTS) -> DataFrame:
    """(repo_id, path, language) of files with an entry point's name."""
    langs = F.array_compact(
        F.array(*[F.when(base_name(F.col("path")).isin(fs), F.lit(lang)) for lang, fs in names.items()])
    )
    return prune_hidden(files).select("repo_id", "path", F.explode(langs).alias("language"))


def new_mode_report(files: DataFrame, skeletons: DataFrame, preview_chars: int | None = None) -> DataFrame:
    """(repo_id, part, rank, item, text): the structure report as ordered rows.

    The parts are totals, file types by count, the first directories, and the
    entry points with skeleton or preview. Rows rather than one text, as a
    repository may have any number of entry points.
    """
    shape = structure(files)
    totals = shape.select(
        "repo_id", F.lit("1 totals").alias("part"),
        F.inline(F.array(
            F.struct(F.lit(1).cast("long").alias("rank"), F.lit("files").alias("item"), F.col("total_files").cast("string").alias("text")),
            F.struct(F.lit(2).cast("long").alias("rank"), F.lit("directories").alias("item"), F.col("total_dirs").cast("string").alias("text")),
        )),
    )
    # Ranked by count through the key itself: no window over a repository.
    kinds = file_types(files).select(
        "repo_id", F.lit("2 types").alias("part"), (-F.col("files")).alias("rank"), F.col("ext").alias("item"),
        F.col("files").cast("string").alias("text"),
    )
    dirs = top_dirs(files).select(
        "repo_id", F.lit("3 directories").alias("part"), "rank",
        F.col("dir").alias("item"), F.lit("").alias("text"),
    )
    found = entry_points(files.select("repo_id", "path"))
    contents = files.select("repo_id", "path", start_of(F.col("content"), preview_chars).alias("preview"))
    entries = (
        found.join(contents, ["repo_id", "path"])
        .join(skeletons, ["repo_id", "path"], "left")
        .select(
            "repo_id", F.lit("4 entry points").alias("part"), F.lit(0).cast("long").alias("rank"),
            F.concat("path", F.lit(" ("), "language", F.lit(")")).alias("item"),
            F.when(F.col("path").endswith(".py"), F.coalesce("skeleton", F.lit(""))).otherwise(F.col("preview")).alias("text"),
        )
    )
    none = (
        shape.join(found.select("repo_id").distinct(), "repo_id", "left_anti")
        .select(
            "repo_id", F.lit("4 entry points").alias("part"), F.lit(0).cast("long").alias("rank"),
            F.lit("No standard entry points detected.").alias("item"), F.lit("").alias("text"),
        )
    )
    out = totals
    for part in (kinds, dirs, entries, none):
        out = out.unionByName(part)
    return out


def tokens(chars: Column) -> Column:
    """Whole tokens for a sum of characters."""
    return F.floor(chars / CHARS_PER_TOKEN).cast("long")


def raw_tokens(files: DataFrame, ext: str = ".py") -> DataFrame:
    """(repo_id, raw_chars, raw_tokens) over files with the extension."""
    return (
        files.filter(F.col("path").endswith(ext))
        .groupBy("repo_id")
        .agg(F.sum(F.length("content")).alias("raw_chars"))
        .withColumn("raw_tokens", tokens(F.col("raw_chars")))
    )


def tool_tokens(context: DataFrame) -> DataFrame:
    """(repo_id, tool_chars, tool_tokens) over context blocks."""
    return (
        context.groupBy("repo_id")
        .agg(F.sum("block_chars").alias("tool_chars"))
        .withColumn("tool_tokens", tokens(F.col("tool_chars")))
    )


def savings(raw_chars: Column, tool_chars: Column) -> Column:
    """Percent saved; 0 where there was nothing to save."""
    raw, tool = raw_chars / CHARS_PER_TOKEN, tool_chars / CHARS_PER_TOKEN
    return F.when(raw > 0, (1 - tool / raw) * 100).otherwise(F.lit(0.0))


def readme_steps(readmes: DataFrame) -> DataFrame:
    """(repo_id, readme_steps): numbered list lines."""
    return readmes.groupBy("repo_id").agg(F.sum(count_numbered_steps(F.col("content"))).cast("long").alias("readme_steps"))


def heuristic_nodes(diagrams: DataFrame) -> DataFrame:
    return diagrams.select("diagram_id", count_bracket_nodes(F.col("code")).cast("long").alias("diagram_steps"))


def evaluation(
    repos: DataFrame, files: DataFrame, context: DataFrame, readmes: DataFrame, diagrams: DataFrame
) -> DataFrame:
    """One row per repository of (repo_id, diagram_id): tokens, share saved, step counts.

    A repository without readable sources stays, with zeros.
    """
    zero = F.lit(0)
    return (
        repos.select("repo_id", "diagram_id")
        .join(raw_tokens(files), "repo_id", "left")
        .join(tool_tokens(context), "repo_id", "left")
        .join(readme_steps(readmes), "repo_id", "left")
        .join(heuristic_nodes(diagrams), "diagram_id", "left")
        .select(
            "repo_id",
            F.coalesce("raw_tokens", zero).alias("raw_tokens"),
            F.coalesce("tool_tokens", zero).alias("tool_tokens"),
            savings(F.coalesce("raw_chars", zero), F.coalesce("tool_chars", zero)).alias("saved_pct"),
            F.coalesce("readme_steps", zero).alias("readme_steps"),
            F.coalesce("diagram_steps", zero).alias("diagram_steps"),
        )
    )


def stage_counts(docs: DataFrame, chunks: DataFrame, keeps: Column, fresh: DataFrame) -> DataFrame:
    """(stage, n): how many rows each ingestion stage has. Chunks are read once for both of their counts."""

    def one(df: DataFrame, stage: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")

    both = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(keeps).alias("kept")).selectExpr(
        "stack(2, 'chunks', chunks, 'kept', kept) AS (stage, n)"
    )
    return one(docs, "docs").unionByName(both).unionByName(one(fresh, "new"))


def observed(df: DataFrame, stage: str, counters: dict[str, Observation]) -> DataFrame:
    """The same rows, counted as ``counters[stage]`` by the action that writes them, without a pass of its own."""
    counters[stage] = Observation(stage)
    return df.observe(counters[stage], F.count(F.lit(1)).alias("n"))


def run_counts(spark: SparkSession, counters: dict[str, Observation]) -> DataFrame:
    """(stage, n) of a run whose rows are written; a row a counter."""
    return spark.createDataFrame([(stage, seen.get["n"]) for stage, seen in counters.items()], "stage string, n long")
