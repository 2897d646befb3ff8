"""Change sets as JSON: reading replies with defaults, routing bad ones, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.functions.text import is_blank, unfence_json

CHANGE = (
    "struct<component:string,type:string,field:string,old_value:string,new_value:string,"
    "impact:string,affected_nodes:array<string>>"
)
CHANGESET = (
    f"struct<changes:array<{CHANGE}>,summary:string,changed_files:array<string>,"
    "impact_assessment:string,_bad:string>"
)


def parse_changesets(replies: DataFrame) -> DataFrame:
    """Add ``parsed`` and ``status`` (none, unknown, ok) to (change_id, diff_text, reply).

    No diff text means no changes; a reply that is not JSON is unknown.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    out = replies.withColumn("parsed", F.from_json(unfence_json(F.col("reply")), CHANGESET, options))
    status = (
        F.when(is_blank(F.col("diff_text")), "none")
        .when(F.col("parsed").isNull() | F.col("parsed._bad").isNotNull(), "unknown")
        .otherwise("ok")
    )
    return out.withColumn("status", status)


def read_changesets(replies: DataFrame) -> DataFrame:
    """(change_id, changes, summary, changed_files, impact_assessment) with defaults filled in."""
    p = parse_changesets(replies)
    ok = F.col("status") == "ok"
    no_changes = F.array().cast(f"array<{CHANGE}>")
    no_files = F.array().cast("array<string>")
    return p.select(
        "change_id",
        F.when(ok, F.coalesce("parsed.changes", no_changes)).otherwise(no_changes).alias("changes"),
        F.when(ok, F.coalesce("parsed.summary", F.lit("Changes detected")))
        .when(F.col("status") == "none", "No changes detected")
        .otherwise("Error parsing semantic diff")
        .alias("summary"),
        F.when(ok, F.coalesce("parsed.changed_files", no_files)).otherwise(no_files).alias("changed_files"),
        F.when(ok, F.coalesce("parsed.impact_assessment", F.lit("medium")))
        .otherwise(F.col("status"))
        .alias("impact_assessment"),
    )


def route_bad(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): replies that hold a change set, and those that do not, with the reason."""
    p = parse_changesets(replies)
    good = p.filter(F.col("status") == "ok").select("change_id", "reply")
    bad = p.filter(F.col("status") != "ok").select("change_id", "reply", F.col("status").alias("reason"))
    return good, bad


def route_replies(replies: DataFrame, path: str) -> DataFrame:
    """(change_id, diff_text, reply, parsed, reason, outcome): parse once and write good and quarantined rows in one job.

    Rows lie in a folder per outcome (good, quarantine) and appear together when the job
    is done; a run that writes again replaces them. Quarantined replies are kept whole.
    """
    good = F.col("status") == "ok"
    routed = parse_changesets(replies).select(
        "change_id", "diff_text", "reply", "parsed", F.when(~good, F.col("status")).alias("reason"),
        F.when(good, "good").otherwise("quarantine").alias("outcome"),
    )
    routed.write.mode("overwrite").partitionBy("outcome").parquet(path)
    return replies.sparkSession.read.schema(routed.schema).parquet(path)


def write_changesets(changesets: DataFrame, path: str) -> None:
    changesets.write.mode("overwrite").json(path)
