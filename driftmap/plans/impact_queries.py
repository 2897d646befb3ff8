"""Queries of change mapping, impact and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import impact as I
from driftmap.plans import derived
from driftmap.plans.oracle import sql
from driftmap.plans.registry import query
from driftmap.session import shared_dir
from driftmap.sources import changesets as S
from driftmap.sources import pages as P
from driftmap.sources import reports as R


def profile(spark, sf):
    return I.diagram_profile(derived.diagrams(spark, sf))


def diff_facts(spark, sf):
    return I.with_diff_facts(derived.diffs(spark, sf))


def impacts(spark, sf):
    return I.impact(I.change_wants(derived.changes(spark, sf)), profile(spark, sf))


@query("map2_nodes_for_steps", sql("SELECT diagram_id, step, node_id FROM step_nodes"))
def map2(spark, sf):
    from driftmap.functions.keywords import STEP_KEYWORDS

    wanted = derived.parts(spark, sf).select("diagram_id").distinct().select(
        "diagram_id", F.explode(F.array(*[F.lit(s) for s in STEP_KEYWORDS])).alias("step")
    )
    return I.nodes_for_steps(wanted, profile(spark, sf))


@query("map3_suggested", sql("SELECT * FROM hit1"))
def map3(spark, sf):
    return I.map_suggested(derived.changes(spark, sf), profile(spark, sf))


@query("map3_suggested_indexed", sql("SELECT * FROM hit1"))
def map3_indexed(spark, sf):
    nodes = profile(spark, sf).select("diagram_id", F.explode("nodes.node_id").alias("node_id"))
    return I.map_suggested_indexed(derived.changes(spark, sf), nodes)


@query("map4_component", sql("SELECT * FROM hit2"))
def map4(spark, sf):
    return I.map_component(derived.changes(spark, sf), profile(spark, sf))


@query("map5_field", sql("SELECT * FROM hit3"))
def map5(spark, sf):
    return I.map_field(derived.changes(spark, sf), profile(spark, sf))


@query("map5_field_indexed", sql("SELECT * FROM hit3"))
def map5_indexed(spark, sf):
    nodes = profile(spark, sf).select("diagram_id", F.explode("nodes").alias("n"))
    tags = nodes.select("diagram_id", "n.node_id", F.explode("n.tags").alias("tag"))
    return I.map_field_indexed(derived.changes(spark, sf), tags)


@query("map6_files", sql("SELECT * FROM raw1"))
def map6(spark, sf):
    return I.map_files(diff_facts(spark, sf), profile(spark, sf))


@query("map7_functions", sql("SELECT * FROM raw2"))
def map7(spark, sf):
    return I.map_functions(diff_facts(spark, sf), profile(spark, sf))


@query("map8_configs", sql("SELECT * FROM hit3"))
def map8(spark, sf):
    return I.map_configs(diff_facts(spark, sf), profile(spark, sf))


@query("map9_diff_text", sql("SELECT * FROM raw4"))
def map9(spark, sf):
    return I.map_text(diff_facts(spark, sf), profile(spark, sf))


@query("map10_dispatch", sql("""
    SELECT a.* FROM affected a JOIN (SELECT DISTINCT change_id, brand_no FROM ch) c ON c.change_id = a.change_id WHERE c.brand_no % 2 = 1 AND c.brand_no <> 3
    UNION ALL
    SELECT a.* FROM raw_affected a JOIN (SELECT DISTINCT change_id, brand_no FROM ch) c ON c.change_id = a.change_id WHERE c.brand_no % 2 = 0"""))
def map10(spark, sf):
    sets = S.read_changesets(derived.replies(spark, sf)).select("change_id", "changes")
    odd = F.regexp_extract("diagram_id", r"#(\d+)/", 1).cast("int") % 2 == 1
    inputs = (
        derived.diffs(spark, sf)
        .join(sets, "change_id")
        .select("change_id", "diagram_id", F.when(odd, F.col("changes")).alias("changes"), "diff_text")
    )
    return I.dispatch(inputs, profile(spark, sf))


@query("map11_affected_set", sql("SELECT * FROM affected"))
def map11(spark, sf):
    changes, p = derived.changes(spark, sf), profile(spark, sf)
    return I.affected_union(I.map_suggested(changes, p), I.map_component(changes, p), I.map_field(changes, p))


@query("map11_affected_one_pass", sql("SELECT * FROM affected"))
def map11_one(spark, sf):
    return I.affected_nodes(I.change_wants(derived.changes(spark, sf)), profile(spark, sf))


@query("map12_impact", sql("SELECT * FROM impacts"))
def map12(spark, sf):
    return impacts(spark, sf)


@query("map12_impact_of_table", sql("SELECT * FROM impacts"))
def map12_table(spark, sf):
    changes, p = derived.changes(spark, sf), profile(spark, sf)
    return I.impact_of_affected(changes, I.affected_nodes(I.change_wants(changes), p), p)


# How a derived repository is set up, from its brand number and day.
REPO_FLAGS = {
    "force_full": "brand_no % 11 = 0", "has_diagram": "brand_no % 7 <> 0", "is_git": "brand_no % 9 <> 0",
    "entry_points_only": "brand_no % 8 = 0",
}
ASKED = "CASE WHEN brand_no % 10 = 0 THEN 'full' WHEN brand_no % 12 = 0 THEN 'incremental' ELSE 'auto' END"


@query("map13_repo_mode", sql(f"""
    SELECT repo_id, asked, CASE WHEN brand_no % 8 = 0 THEN 'new' WHEN asked <> 'auto' THEN asked
      WHEN brand_no % 9 <> 0 AND brand_no % 7 <> 0 THEN 'incremental' WHEN brand_no % 9 <> 0 THEN 'new' ELSE 'full' END AS mode
    FROM (SELECT k AS repo_id, brand_no, {ASKED} AS asked FROM parts)"""))
def map13(spark, sf):
    flags = [f"({e}) AS {name}" for name, e in REPO_FLAGS.items()]
    repos = derived.parts(spark, sf).selectExpr("k AS repo_id", f"{ASKED} AS asked", *flags)
    return I.repo_mode(repos).select("repo_id", "asked", "mode")


def decisions(spark, sf):
    """One repository per change set: its diagram page, its diff, and the impact of both."""
    d = derived.diagrams(spark, sf)
    brand = F.regexp_extract("diagram_id", r"#(\d+)/", 1).cast("int")
    paged = d.withColumn("brand_no", brand).select(
        "diagram_id", F.when(F.col("brand_no") % 13 == 0, F.lit("<html></html>")).otherwise(P.page_of(F.col("code"))).alias("html")
    )
    flags = [f"({REPO_FLAGS[x]}) AS {x}" for x in ("force_full", "has_diagram", "is_git")]
    runs = (
        derived.diffs(spark, sf)
        .join(impacts(spark, sf), ["change_id", "diagram_id"])
        .join(P.extract_diagrams(paged), "diagram_id")
        .withColumn("brand_no", brand)
        .withColumn("diff_text", F.when(F.col("brand_no") % 17 == 0, "").otherwise(F.col("diff_text")))
        .withColumn(
            "n_changed",
            F.when(F.col("brand_no") % 19 == 0, 0).otherwise(F.regexp_count("diff_text", F.lit(r"diff --git a/\S+\.py b/"))),
        )
        .selectExpr("*", "change_id AS repo_id", *flags)
    )
    return I.decide(runs)


DECISIONS = """
    SELECT repo_id, CASE WHEN reason IS NULL THEN 'incremental' ELSE 'full' END AS mode,
      coalesce(reason, 'Low impact - using incremental update') AS reason,
      CASE WHEN reason IS NULL THEN affected ELSE 0 END AS affected, CASE WHEN reason IS NULL THEN total ELSE 0 END AS total,
      CASE WHEN reason IS NULL THEN impact_pct ELSE 0.0 END AS impact_pct,
      CASE WHEN reason IS NULL THEN impact_level ELSE 'none' END AS impact_level,
      CASE WHEN reason IS NULL OR reason LIKE 'High%' THEN impact_pct END AS measured_pct
    FROM (
      SELECT i.change_id AS repo_id, affected, total, impact_pct, impact_level,
        CASE WHEN brand_no % 11 = 0 THEN '--force-full flag set' WHEN brand_no % 7 = 0 THEN 'No existing diagram found'
          WHEN brand_no % 9 = 0 THEN 'Not a git repository'
          WHEN brand_no % 19 = 0 OR brand_no % 17 = 0 OR n_code = 0 THEN 'No changes detected'
          WHEN brand_no % 13 = 0 THEN 'Could not parse existing diagram'
          WHEN impact_pct > 50 THEN 'High impact - using full regeneration' END AS reason
      FROM impacts i JOIN (SELECT change_id, brand_no, count(*) FILTER (path LIKE '%.py') AS n_code FROM diff_rows GROUP BY ALL) c
        ON c.change_id = i.change_id)"""


@query("map14_decisions", sql(DECISIONS))
def map14(spark, sf):
    return decisions(spark, sf)


@query("map15_fleet_summary", sql(f"""
    SELECT mode, impact_level, count(*) AS repos, CAST(sum(affected) AS BIGINT) AS affected, avg(impact_pct) AS mean_pct
    FROM ({DECISIONS}) GROUP BY mode, impact_level"""))
def map15(spark, sf):
    return I.fleet_summary(decisions(spark, sf))


@query("src15_report_sink", sql(f"""
    SELECT r.*, d.diff_text AS diff_start, length(d.diff_text) AS diff_chars, t.run_id
    FROM ({DECISIONS}) r LEFT JOIN diffs d ON d.change_id = r.repo_id, (VALUES ('first'), ('second')) t(run_id)"""))
def src15_sink(spark, sf):
    """Two runs write their report, the first of them twice."""
    base = shared_dir(spark, "reports")
    diffs = derived.diffs(spark, sf).select(F.col("change_id").alias("repo_id"), "diff_text")
    R.decision_report(decisions(spark, sf), diffs).write.parquet(f"{base}/rows")
    for run in ("first", "second", "first"):
        R.write_report(spark.read.parquet(f"{base}/rows"), f"{base}/reports", run)
    return spark.read.parquet(f"{base}/reports")


@query("src15_decision_report", sql(f"""
    SELECT r.*, d.diff_text AS diff_start, length(d.diff_text) AS diff_chars
    FROM ({DECISIONS}) r LEFT JOIN diffs d ON d.change_id = r.repo_id"""))
def src15(spark, sf):
    diffs = derived.diffs(spark, sf).select(F.col("change_id").alias("repo_id"), "diff_text")
    return R.decision_report(decisions(spark, sf), diffs)
