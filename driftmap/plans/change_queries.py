"""Queries of the change operators, on snapshots of documents and diffs of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import changes as C
from driftmap.plans import derived
from driftmap.plans.oracle import sql
from driftmap.plans.registry import query
from driftmap.session import shared_dir
from driftmap.sources import changesets as S


@query("chg1_snapshot_diff", sql("""
    SELECT repo_id, path, CASE WHEN doc_id % 17 = 0 THEN 'added' WHEN doc_id % 19 = 0 THEN 'deleted' ELSE 'modified' END AS change
    FROM files WHERE (doc_id % 17 = 0) <> (doc_id % 19 = 0)
      OR (doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 10 = 0)"""))
def chg1(spark, sf):
    return C.snapshot_diff(*derived.snapshots(spark, sf))


@query("chg2_changed_files", sql("""
    SELECT DISTINCT repo_id, path FROM files WHERE ext IN ('.py', '.js', '.ts', '.java') AND (doc_id % 2 = 0 OR doc_id % 3 = 0)"""))
def chg2(spark, sf):
    f = derived.files(spark, sf)
    return C.changed_files(f.filter(F.col("doc_id") % 2 == 0), f.filter(F.col("doc_id") % 3 == 0))


@query("chg3_diff_paths", sql("""
    SELECT change_id, CAST(row_number() OVER (PARTITION BY change_id ORDER BY event_id) - 1 AS INTEGER) AS pos, path FROM diff_rows"""))
def chg3(spark, sf):
    return C.diff_paths(derived.diffs(spark, sf))


@query("chg4_diff_functions", sql('SELECT DISTINCT change_id, fn AS "function" FROM diff_rows WHERE fn IS NOT NULL'))
def chg4(spark, sf):
    return C.diff_functions(derived.diffs(spark, sf))


@query("chg5_diff_configs", sql("""
    SELECT change_id, field AS key, CASE WHEN bool_or(event_id % 7 = 0) THEN arg_max(new_value, event_id) FILTER (event_id % 7 = 0)
      ELSE arg_max(new_value, event_id) END AS value FROM diff_rows GROUP BY change_id, field"""))
def chg5(spark, sf):
    return C.diff_configs(derived.diffs(spark, sf))


@query("chg6_diff_steps", sql("SELECT change_id, step FROM diff_set"))
def chg6(spark, sf):
    return C.diff_steps(derived.diffs(spark, sf))


@query("chg7_change_rows", sql("""
    SELECT change_id, CAST(row_number() OVER (PARTITION BY change_id ORDER BY event_id) - 1 AS INTEGER) AS pos,
      lower(component) AS component, 'config_update' AS type, field, old_value, new_value,
      array_to_string(affected_nodes, ',') AS affected_nodes
    FROM ch WHERE brand_no NOT IN (2, 3, 4)"""))
def chg7(spark, sf):
    rows = C.change_rows(S.read_changesets(derived.replies(spark, sf)))
    return rows.withColumn("affected_nodes", F.array_join("affected_nodes", ","))


@query("chg8_value_changes", sql("""
    SELECT user_id, event_type, event_id, coalesce(old, 'N/A') AS old_value, value AS new_value FROM (
      SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM (
        SELECT *, json_extract_string(props, '$.k') AS value FROM (SELECT event_id, ts, user_id, event_type, props FROM events)))
    WHERE old IS DISTINCT FROM value"""))
def chg8(spark, sf):
    h = derived.table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").alias("value")
    )
    return C.value_changes(h, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "old_value", "new_value")


@query("chg9_classify", sql("""
    SELECT repo_id, key, CASE WHEN was IS NULL THEN 'new_component' WHEN now IS NULL THEN 'removed_component' ELSE 'config_update' END AS type,
      coalesce(was, 'N/A') AS old_value, coalesce(now, 'N/A') AS new_value
    FROM (
      SELECT user_id AS repo_id, event_type AS key, arg_max(v, event_id) FILTER (half = 0) AS was, arg_max(v, event_id) FILTER (half = 1) AS now
      FROM (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS v, CAST(day(ts) > 15 AS INTEGER) AS half FROM events)
      GROUP BY user_id, event_type)
    WHERE was IS DISTINCT FROM now"""))
def chg9(spark, sf):
    e = derived.table(spark, sf, "events").select(
        F.col("user_id").alias("repo_id"), F.col("event_type").alias("key"), "event_id",
        F.get_json_object("props", "$.k").alias("v"), (F.dayofmonth("ts") > 15).alias("late"),
    )

    def last(df):
        return df.groupBy("repo_id", "key").agg(F.max_by("v", "event_id").alias("value"))

    return C.classify(last(e.filter(~F.col("late"))), last(e.filter("late")))


@query("prj8_code_sections", sql("""
    SELECT change_id, path, event_id FROM (
      SELECT *, bool_or(NOT is_md) OVER (PARTITION BY change_id) AS any_code FROM (
        SELECT diagram_id || '#' || field || event_id % 40 AS change_id, CASE WHEN event_id % 13 < 6 THEN field || '.cfg' ELSE path END AS path,
          event_id, event_id % 11 = 0 OR event_id % 13 < 6 AS is_md FROM diff_rows))
    WHERE NOT is_md OR (NOT any_code AND path NOT LIKE '%.md')"""))
def prj8(spark, sf):
    e = F.col("event_id")
    sections = derived.changes(spark, sf).select(
        F.concat("diagram_id", F.lit("#"), "field", (e % 40).cast("string")).alias("change_id"),
        F.when(e % 13 < 6, F.concat("field", F.lit(".cfg"))).otherwise(
            F.concat(F.lit("src/"), "field", F.lit("_"), (e % 4).cast("string"), F.when(e % 11 == 0, ".md").otherwise(".py"))
        ).alias("path"),
        "event_id",
    )
    return C.code_sections(sections)


@query("src7_read_changesets", sql("""
    SELECT change_id, CASE WHEN brand_no IN (2, 3, 4) THEN 0 ELSE n END AS n_changes,
      CASE WHEN brand_no = 2 THEN 'Changes detected' WHEN brand_no = 3 THEN 'Error parsing semantic diff'
        WHEN brand_no = 4 THEN 'No changes detected' ELSE 'day of ' || diagram_id END AS summary,
      CASE WHEN brand_no IN (2, 3, 4) THEN '' ELSE 'src/a.py' END AS changed_files,
      CASE WHEN brand_no = 2 THEN 'medium' WHEN brand_no = 3 THEN 'unknown' WHEN brand_no = 4 THEN 'none' ELSE 'low' END AS impact_assessment
    FROM (SELECT change_id, diagram_id, brand_no, CAST(count(*) AS INTEGER) AS n FROM ch GROUP BY ALL)"""))
def src7(spark, sf):
    return S.read_changesets(derived.replies(spark, sf)).select(
        "change_id", F.size("changes").alias("n_changes"), "summary",
        F.array_join("changed_files", ",").alias("changed_files"), "impact_assessment",
    )


@query("src8_quarantine", sql("""
    SELECT change_id, CASE WHEN brand_no IN (3, 4) THEN 'quarantine' ELSE 'good' END AS outcome,
      CASE brand_no WHEN 3 THEN 'unknown' WHEN 4 THEN 'none' END AS reason, CASE WHEN brand_no IN (3, 4) THEN 0 WHEN brand_no = 2 THEN NULL ELSE n END AS n_changes,
      CASE brand_no WHEN 3 THEN '{"changes": [' || change_id END AS kept
    FROM (SELECT change_id, brand_no, CAST(count(*) AS INTEGER) AS n FROM ch GROUP BY ALL)"""))
def src8_quarantine(spark, sf):
    """All replies, parsed once and written by outcome; broken ones are kept whole."""
    routed = S.route_replies(derived.replies(spark, sf), shared_dir(spark, "routed"))
    broken = F.col("outcome") == "quarantine"
    return routed.select(
        "change_id", "outcome", "reason", F.when(broken, 0).otherwise(F.size("parsed.changes")).alias("n_changes"),
        F.when(F.col("reason") == "unknown", F.col("reply")).alias("kept"),
    )


@query("src8_route_bad", sql("""
    SELECT change_id, CASE brand_no WHEN 3 THEN 'unknown' WHEN 4 THEN 'none' ELSE 'good' END AS routed
    FROM (SELECT DISTINCT change_id, brand_no FROM ch)"""))
def src8(spark, sf):
    good, bad = S.route_bad(derived.replies(spark, sf))
    return good.select("change_id", F.lit("good").alias("routed")).unionByName(
        bad.select("change_id", F.col("reason").alias("routed"))
    )
