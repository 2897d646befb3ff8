"""Snapshot differences, diff text and change sets as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from driftmap.functions.keywords import steps_in_diff
from driftmap.functions.text import computed, start_of
from driftmap.sources.tree import CHANGED_EXTENSIONS, filter_ext

# Extensions a diff keeps while it has any such section.
DIFF_EXTENSIONS = [".py", ".js", ".ts", ".java", ".go", ".rb"]
DIFF_CUT_NOTE = "\n\n... (diff truncated for length)"

# What is read out of raw diff text.
DIFF_FILE = r"(?dU)diff --git a/(.*?) b/"
DIFF_FUNCTION = r"(?U)[-+]\s*def\s+(\w+)\s*\("
DIFF_NUMBER = r"(?U)[-+]\s*(\w+)\s*=\s*(\d+)"
DIFF_STRING = r"""(?U)[-+]\s*(\w+)\s*=\s*["']([^"']+)["']"""


def snapshot_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(repo_id, path, change): added, modified or deleted files of two snapshots.

    Contents are reduced to a digest before the join, so text is never shuffled.
    """
    keys = ["repo_id", "path"]
    old = base.select(*keys, F.sha2("content", 256).alias("old"), F.lit(1).alias("was"))
    new = head.select(*keys, F.sha2("content", 256).alias("new"), F.lit(1).alias("is"))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "deleted")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    )
    return (
        old.join(new, keys, "full_outer")
        .select(*keys, change.alias("change"))
        .filter(F.col("change").isNotNull())
    )


def changed_files(tracked: DataFrame, untracked: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Distinct (repo_id, path) of both lists, supported extensions only."""
    both = tracked.select("repo_id", "path").unionByName(untracked.select("repo_id", "path"))
    return filter_ext(both, extensions or CHANGED_EXTENSIONS).distinct()


def code_sections(sections: DataFrame) -> DataFrame:
    """Diff sections worth reading: code ones, or all but ``.md`` where a change has no code.

    Code sections pass in the scan. The rest need one look-up against the
    distinct changes that have code.
    """

    def ends_with(options: list[str]) -> Column:
        out = F.lit(False)
        for e in options:
            out = out | F.col("path").endswith(e)
        return out

    code = sections.filter(ends_with(DIFF_EXTENSIONS))
    rest = sections.filter(~ends_with(DIFF_EXTENSIONS) & ~F.col("path").endswith(".md"))
    return code.unionByName(rest.join(code.select("change_id").distinct(), "change_id", "left_anti"))


def diff_paths(diffs: DataFrame) -> DataFrame:
    """(change_id, pos, path) for each file header in diff text."""
    return diffs.select(
        "change_id", F.posexplode(F.regexp_extract_all("diff_text", F.lit(DIFF_FILE), F.lit(1))).alias("pos", "path")
    )


def diff_functions(diffs: DataFrame) -> DataFrame:
    """Distinct (change_id, function) whose definition line changed."""
    return diffs.select(
        "change_id",
        F.explode(F.array_distinct(F.regexp_extract_all("diff_text", F.lit(DIFF_FUNCTION), F.lit(1)))).alias("function"),
    )


def diff_configs(diffs: DataFrame) -> DataFrame:
    """(change_id, key, value): settings in diff text, string over number, later over earlier."""

    def found(pattern: str, stage: int) -> Column:
        text = F.col("diff_text")
        return F.transform(
            F.arrays_zip(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("key"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"),
            ),
            lambda kv, i: F.struct(
                F.lit(stage).alias("stage"), i.alias("pos"), kv["key"].alias("key"), kv["value"].alias("value")
            ),
        )

    return (
        diffs.select("change_id", F.explode(F.concat(found(DIFF_NUMBER, 0), found(DIFF_STRING, 1))).alias("c"))
        .groupBy("change_id", F.col("c.key").alias("key"))
        .agg(F.max_by("c.value", F.struct("c.stage", "c.pos")).alias("value"))
    )


def diff_steps(diffs: DataFrame) -> DataFrame:
    """(change_id, step) for each setting pattern found in diff text."""
    return diffs.select("change_id", F.explode(steps_in_diff(F.col("diff_text"))).alias("step"))


def cut_diff(diff_text: Column, limit: int | None = None) -> Column:
    """A diff for a request, with a note where a limit that is given cuts it."""
    return start_of(diff_text, limit, DIFF_CUT_NOTE)


def change_rows(changesets: DataFrame) -> DataFrame:
    """One row per change of a change set, missing texts as empty strings."""
    return changesets.select("change_id", F.posexplode(computed("changes")).alias("pos", "c")).select(
        "change_id",
        "pos",
        F.lower(F.coalesce("c.component", F.lit(""))).alias("component"),
        F.coalesce("c.type", F.lit("")).alias("type"),
        F.lower(F.coalesce("c.field", F.lit(""))).alias("field"),
        F.col("c.old_value").alias("old_value"),
        F.col("c.new_value").alias("new_value"),
        F.col("c.affected_nodes").alias("affected_nodes"),
    )


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970, in the order of the column for both kinds of timestamp."""
    at = F.col(column)
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.unix_date(at.cast("date")) * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60 + F.second(at)
    return F.unix_seconds(at)


def value_changes(
    history: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id",
    value: str = "value", bucket_seconds: int = 60,
) -> DataFrame:
    """Rows whose value differs from the previous one of the same key, with that old value.

    The first value of a key has old value ``N/A``; an old value that was null is null. A key may own a large part
    of all rows, so "previous row" is found within (key, time bucket), and only
    the first row of each bucket looks further, at the last value of the bucket
    before: no task sees more than one bucket of rows, or one row per bucket.
    """
    slot = [*keys, "bucket"]
    within = Window.partitionBy(*slot).orderBy(ts, tie)
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = history.withColumn("bucket", F.floor(epoch_seconds(history, ts) / bucket_seconds)).withColumns({
        "rn": F.row_number().over(within),
        "old_raw": F.lag(value).over(within),
        "slot_last": F.last(value).over(whole),
    })
    buckets = Window.partitionBy(*keys).orderBy("bucket")
    later = h.filter(F.col("rn") > 1).withColumn("was", F.lit(True))
    firsts = h.filter(F.col("rn") == 1).withColumns({
        "old_raw": F.lag("slot_last").over(buckets), "was": F.coalesce(F.lag(F.lit(True)).over(buckets), F.lit(False)),
    })
    return (
        later.unionByName(firsts)
        .filter(~F.col("was") | ~F.col("old_raw").eqNullSafe(F.col(value)))
        .withColumn("old_value", F.when(F.col("was"), F.col("old_raw").cast("string")).otherwise("N/A"))
        .withColumn("new_value", F.col(value).cast("string"))
        .drop("bucket", "rn", "old_raw", "slot_last", "was")
    )


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, key, type, old_value, new_value) by presence of a key before and after."""
    keys = ["repo_id", "key"]
    a = old.select(*keys, F.col("value").alias("old_value"), F.lit(1).alias("was"))
    b = new.select(*keys, F.col("value").alias("new_value"), F.lit(1).alias("is"))
    kind = (
        F.when(F.col("was").isNull(), "new_component")
        .when(F.col("is").isNull(), "removed_component")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "config_update")
    )
    none = F.lit("N/A")
    return (
        a.join(b, keys, "full_outer")
        .withColumn("type", kind)
        .filter(F.col("type").isNotNull())
        .select(
            *keys, "type",
            F.when(F.col("was").isNull(), none).otherwise(F.col("old_value")).alias("old_value"),
            F.when(F.col("is").isNull(), none).otherwise(F.col("new_value")).alias("new_value"),
        )
    )


