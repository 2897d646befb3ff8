"""Decision reports and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.functions.text import start_of
from driftmap.operators import keyed


def decision_report(decisions: DataFrame, diffs: DataFrame, diff_chars: int | None = None) -> DataFrame:
    """Decisions with the diff they rest on, or its start if a limit is given."""
    cut = start_of(F.col("diff_text"), diff_chars)
    return decisions.join(diffs.select("repo_id", cut.alias("diff_start"), F.length("diff_text").cast("long").alias("diff_chars")), "repo_id", "left")


def write_report(report: DataFrame, path: str, run: str) -> None:
    """Write the report of a run; a run that writes again replaces its own rows and no others."""
    rows = report.withColumn("run_id", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def run_log_rows(runs: DataFrame, *keep: str) -> DataFrame:
    """Log rows of finished and failed runs.

    ``runs`` is (application_name, job_name, started, ended, num_embeddings,
    num_new_embeddings, input_file, output_type, output_name, error). A failed
    run keeps its times and its error, nothing else. Columns of ``keep`` stay in front.
    """
    ok = F.col("error").isNull()
    output = F.array(F.struct(F.col("output_type").alias("type"), F.col("output_name").alias("name")))
    return runs.select(
        *keep,
        "application_name",
        "job_name",
        F.col("started").alias("start_timestamp"),
        F.col("ended").alias("end_timestamp"),
        F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1_000_000).cast("int").alias("duration_in_seconds"),
        F.when(ok, F.col("num_embeddings")).alias("num_embeddings"),
        F.when(ok, F.col("num_new_embeddings")).alias("num_new_embeddings"),
        F.when(ok, F.col("input_file")).alias("input_file"),
        F.when(ok, output).alias("output"),
        F.when(ok, "success").otherwise("failed").alias("status"),
        "error",
    )


def log_runs(rows: DataFrame, base: str, buckets: int = 16) -> None:
    """Put log rows with their ``run_id`` into the log table below ``base``; a run that is logged again has its last row.

    A run_id that comes more than once in ``rows`` keeps the row that ended last.
    """
    columns = [c for c in rows.columns if c != "run_id"]
    once = rows.groupBy("run_id").agg(F.max_by(F.struct(*columns), F.struct("end_timestamp", "status")).alias("r")).select("run_id", "r.*")
    if keyed.manifest(rows.sparkSession, base) is None:
        keyed.create(once.limit(0), base, "run_id", buckets)
    keyed.apply(rows.sparkSession, base, once, lambda was, new: new)


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
