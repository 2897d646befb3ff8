"""Changes to the diagram nodes they touch, and what follows from the share touched.

A diagram is condensed to one profile row, a change set to one row of what it
points at: steps, words and node names. The two meet in one join on
``diagram_id`` and every rule is a test inside the joined row, so only touched
nodes are emitted, never node x change pairs, and no further shuffle is needed
to make them distinct. Nothing after the join asks for its partitioning, which
leaves Spark free to split a hot diagram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.functions.keywords import (
    STEP_KEYWORDS,
    steps_in_diff,
    steps_named_in,
    steps_of_component,
    with_keyword_tags,
)
from driftmap.functions.text import computed
from driftmap.operators.changes import DIFF_FILE, DIFF_FUNCTION, DIFF_NUMBER, DIFF_STRING
from driftmap.operators.diagram import diagram_items
from driftmap.operators.dictionary import contained
from driftmap.session import shared_dir
from driftmap.sources.tree import base_name

CHANGE_RULES = ("suggested", "component", "field")
DIFF_RULES = ("files", "functions", "configs", "text")


def _none() -> Column:
    return F.array().cast("array<string>")


def _or_none(c: Column) -> Column:
    return F.coalesce(c, _none())


def diagram_profile(diagrams: DataFrame, steps: dict[str, list[str]] = STEP_KEYWORDS) -> DataFrame:
    """(diagram_id, total, nodes): one row per diagram that has nodes.

    A node carries its tags and its steps: those it is tagged with, and those
    the name of a subgraph it stands in contains. The group is bounded by the
    diagram text it was read from.
    """
    placed = F.array_distinct(F.transform("members", lambda m: F.lower(m["subgraph"])))

    def belongs(step: str) -> Column:
        return F.array_contains("tags", step) | F.exists("placed", lambda name: name.contains(step.lower()))

    own_steps = F.array_compact(F.array(*[F.when(belongs(step), F.lit(step)) for step in steps]))
    nodes = (
        diagram_items(diagrams)
        .filter(F.col("part") == "node")
        .select("diagram_id", F.col("key").alias("node_id"), F.col("value.content").alias("content"), placed.alias("placed"))
    )
    return (
        with_keyword_tags(nodes, "content", "tags", steps)
        .select("diagram_id", "node_id", "tags", own_steps.alias("steps"))
        .groupBy("diagram_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.array_sort(
                F.collect_list(F.struct("node_id", "tags", "steps", F.lower("node_id").alias("low_id")))
            ).alias("nodes"),
        )
    )


def change_wants(changes: DataFrame, rules: tuple[str, ...] = CHANGE_RULES) -> DataFrame:
    """(change_id, diagram_id, steps, words, names): what the rows of a change set point at.

    ``changes`` has one row per change, with component, field and
    affected_nodes. Rows of a change set are merged as sets before the shuffle.
    """
    steps = steps_of_component(F.coalesce("component", F.lit(""))) if "component" in rules else _none()
    word = F.lower(F.coalesce("field", F.lit(""))) if "field" in rules else F.lit(None).cast("string")
    names = _or_none(F.transform("affected_nodes", F.lower)) if "suggested" in rules else _none()
    return (
        changes.select("change_id", "diagram_id", steps.alias("steps"), word.alias("word"), names.alias("names"))
        .groupBy("change_id", "diagram_id")
        .agg(
            F.array_distinct(F.flatten(F.collect_set("steps"))).alias("steps"),
            F.collect_set("word").alias("words"),
            F.array_compact(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"),
        )
    )


def changeset_wants(changesets: DataFrame) -> DataFrame:
    """The same for change sets that still hold their changes as one array."""
    each = F.col("changes")
    return changesets.select(
        "change_id",
        "diagram_id",
        F.array_distinct(
            F.flatten(F.transform(each, lambda c: steps_of_component(F.coalesce(c["component"], F.lit("")))))
        ).alias("steps"),
        F.array_distinct(F.transform(each, lambda c: F.lower(F.coalesce(c["field"], F.lit(""))))).alias("words"),
        F.array_compact(F.array_distinct(
            F.flatten(F.transform(each, lambda c: _or_none(F.transform(c["affected_nodes"], F.lower))))
        )).alias("names"),
    )


def with_diff_facts(diffs: DataFrame) -> DataFrame:
    """Add changed_files, changed_functions and changed_keys, read out of the diff text."""

    def every(pattern: str) -> Column:
        return F.regexp_extract_all("diff_text", F.lit(pattern), F.lit(1))

    return (
        diffs.withColumn("changed_files", every(DIFF_FILE))
        .withColumn("changed_functions", F.array_distinct(every(DIFF_FUNCTION)))
        .withColumn("changed_keys", F.array_union(every(DIFF_NUMBER), every(DIFF_STRING)))
    )


def diff_wants(diffs: DataFrame, rules: tuple[str, ...] = DIFF_RULES) -> DataFrame:
    """What raw diffs point at: one row each, with the facts of ``with_diff_facts``."""

    def named(names: Column) -> Column:
        return F.flatten(F.transform(names, lambda x: steps_named_in(x)))

    found = []
    if "files" in rules:
        found.append(named(F.array_distinct(F.transform("changed_files", lambda p: base_name(p)))))
    if "functions" in rules:
        found.append(named(F.col("changed_functions")))
    if "text" in rules:
        found.append(steps_in_diff(F.col("diff_text")))
    words = F.transform("changed_keys", F.lower) if "configs" in rules else _none()
    return diffs.select(
        "change_id", "diagram_id", F.array_distinct(F.concat(_none(), *found)).alias("steps"), words.alias("words"),
        _none().alias("names"),
    )


def touched(wants: DataFrame, profile: DataFrame) -> DataFrame:
    """(change_id, diagram_id, touched, total): the node ids each change set touches.

    A node is touched if one of the names is inside its id or the other way
    round, if it belongs to a wanted step, or if one of its tags is inside a
    wanted word. Change sets of diagrams without nodes keep total 0.
    """
    hit = F.filter(
        "nodes",
        lambda n: F.arrays_overlap(n["steps"], F.col("steps"))
        | F.exists("names", lambda s: n["low_id"].contains(s) | s.contains(n["low_id"]))
        | F.exists(n["tags"], lambda t: F.exists("words", lambda w: w.contains(t))),
    )
    return wants.join(profile, "diagram_id", "left").select(
        "change_id", "diagram_id",
        _or_none(F.transform(hit, lambda n: n["node_id"])).alias("touched"),
        F.coalesce("total", F.lit(0)).alias("total"),
    )


def affected_nodes(wants: DataFrame, profile: DataFrame) -> DataFrame:
    """(change_id, diagram_id, node_id), each once."""
    return touched(wants, profile).select("change_id", "diagram_id", F.explode(computed("touched")).alias("node_id"))


def map_suggested(changes: DataFrame, profile: DataFrame) -> DataFrame:
    """Nodes whose id is inside a suggestion or has one inside it, case ignored."""
    return affected_nodes(change_wants(changes, ("suggested",)), profile)


def map_suggested_indexed(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for long lists of suggestions and large diagrams: both ways by an index, and never empty names.

    ``nodes`` is (diagram_id, node_id).
    """
    spark, base = changes.sparkSession, shared_dir(changes.sparkSession, "suggested")
    names = changes.select("change_id", "diagram_id", F.explode("affected_nodes").alias("name")).select("change_id", "diagram_id", F.lower("name").alias("name"))
    # read several times below; the sizes of their files say little about those in memory, so no join sends them
    names.distinct().write.parquet(f"{base}/names")
    nodes.select("diagram_id", "node_id", F.lower("node_id").alias("text")).distinct().write.parquet(f"{base}/ids")
    names, ids = spark.read.parquet(f"{base}/names"), spark.read.parquet(f"{base}/ids")
    own = names.select("diagram_id", "name").distinct()
    inside = contained(ids, own.withColumnRenamed("name", "word"), ["diagram_id"]).withColumnRenamed("word", "name")
    around = contained(own.withColumn("text", F.col("name")), ids.withColumnRenamed("text", "word"), ["diagram_id"])
    pairs = inside.select("diagram_id", "name", "node_id").union(around.select("diagram_id", "name", "node_id")).distinct()
    return names.hint("merge").join(pairs, ["diagram_id", "name"]).select("change_id", "diagram_id", "node_id").distinct()


def map_component(changes: DataFrame, profile: DataFrame) -> DataFrame:
    """Nodes of the steps a component names."""
    return affected_nodes(change_wants(changes, ("component",)), profile)


def map_field(changes: DataFrame, profile: DataFrame) -> DataFrame:
    """Nodes with a tag inside the field name; an empty field touches none."""
    return affected_nodes(change_wants(changes, ("field",)), profile)


def map_field_indexed(changes: DataFrame, tags: DataFrame) -> DataFrame:
    """The same for large dictionaries; ``tags`` is (diagram_id, node_id, tag)."""
    fields = changes.select("change_id", "diagram_id", F.lower("field").alias("text")).where("text <> ''").distinct()
    wanted = tags.select("diagram_id", F.col("tag").alias("word")).distinct()
    hit = contained(fields, wanted, ["diagram_id"])
    return hit.join(tags.withColumnRenamed("tag", "word"), ["diagram_id", "word"]).select("change_id", "diagram_id", "node_id").distinct()


def map_files(diffs: DataFrame, profile: DataFrame) -> DataFrame:
    """Nodes of the steps named in changed file names."""
    return affected_nodes(diff_wants(diffs, ("files",)), profile)


def map_functions(diffs: DataFrame, profile: DataFrame) -> DataFrame:
    """Nodes of the steps named in changed function names."""
    return affected_nodes(diff_wants(diffs, ("functions",)), profile)


def map_configs(diffs: DataFrame, profile: DataFrame) -> DataFrame:
    """Nodes with a tag inside a changed setting name."""
    return affected_nodes(diff_wants(diffs, ("configs",)), profile)


def map_text(diffs: DataFrame, profile: DataFrame) -> DataFrame:
    """Nodes of the steps whose settings appear in the diff text."""
    return affected_nodes(diff_wants(diffs, ("text",)), profile)


def nodes_for_steps(wanted: DataFrame, profile: DataFrame) -> DataFrame:
    """(diagram_id, step, node_id) for distinct wanted (diagram_id, step) rows."""
    own = F.filter("nodes", lambda n: F.array_contains(n["steps"], F.col("step")))
    return wanted.join(profile, "diagram_id").select(
        "diagram_id", "step", F.explode(F.transform(own, lambda n: n["node_id"])).alias("node_id")
    )


def dispatch_wants(inputs: DataFrame) -> DataFrame:
    """Wants of mixed inputs (change_id, diagram_id, changes, diff_text): change lists where present, else diff text."""
    listed = changeset_wants(inputs.filter(F.col("changes").isNotNull()))
    raw = diff_wants(with_diff_facts(inputs.filter(F.col("changes").isNull())))
    return listed.unionByName(raw)


def dispatch(inputs: DataFrame, profile: DataFrame) -> DataFrame:
    """Affected nodes of mixed inputs."""
    return affected_nodes(dispatch_wants(inputs), profile)


def affected_union(*parts: DataFrame) -> DataFrame:
    """The affected set of several rules, each node once per change."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("change_id", "diagram_id", "node_id").distinct()


def impact_level(total: Column, pct: Column) -> Column:
    return (
        F.when(total == 0, "full")
        .when(pct == 0, "none")
        .when(pct < 20, "low")
        .when(pct < 50, "medium")
        .when(pct < 80, "high")
        .otherwise("full")
    )


def impact(wants: DataFrame, profile: DataFrame) -> DataFrame:
    """(change_id, diagram_id, affected, total, impact_pct, impact_level) for every change set."""
    n, total = F.size("touched").cast("long"), F.col("total")
    pct = F.when(total == 0, 100.0).otherwise(n / total * 100)
    return (
        touched(wants, profile)
        .select("change_id", "diagram_id", n.alias("affected"), "total", pct.alias("impact_pct"))
        .withColumn("impact_level", impact_level(F.col("total"), F.col("impact_pct")))
    )


def impact_of_affected(change_ids: DataFrame, affected: DataFrame, totals: DataFrame) -> DataFrame:
    """The same from an affected set that is already a table.

    ``change_ids`` is (change_id, diagram_id), ``totals`` (diagram_id, total).
    """
    counts = affected.groupBy("change_id", "diagram_id").agg(F.countDistinct("node_id").alias("affected"))
    n, total = F.coalesce("affected", F.lit(0)), F.coalesce("total", F.lit(0))
    pct = F.when(total == 0, 100.0).otherwise(n / total * 100)
    return (
        change_ids.select("change_id", "diagram_id").distinct()
        .join(counts, ["change_id", "diagram_id"], "left")
        .join(totals.select("diagram_id", "total"), "diagram_id", "left")
        .select("change_id", "diagram_id", n.alias("affected"), total.alias("total"), pct.alias("impact_pct"))
        .withColumn("impact_level", impact_level(F.col("total"), F.col("impact_pct")))
    )


def repo_mode(repos: DataFrame) -> DataFrame:
    """Add ``mode`` from has_diagram and is_git, unless ``asked`` names one itself."""
    found = (
        F.when(F.col("is_git") & F.col("has_diagram"), "incremental")
        .when(F.col("is_git"), "new")
        .otherwise("full")
    )
    asked = F.when(F.col("asked") != "auto", F.col("asked"))
    entry_only = F.when(F.col("entry_points_only"), F.lit("new"))
    return repos.withColumn("mode", F.coalesce(entry_only, asked, found))


def decide(repos: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Incremental or full per repository, with the first reason that applies.

    ``repos`` has force_full, has_diagram, is_git, n_changed, code, diff_text,
    affected, total. Only a share strictly over the threshold asks for a full run.
    """
    n, total = F.coalesce("affected", F.lit(0)), F.coalesce("total", F.lit(0))
    pct = F.when(total == 0, 100.0).otherwise(n / total * 100)
    reason = (
        F.when(F.col("force_full"), "--force-full flag set")
        .when(~F.col("has_diagram"), "No existing diagram found")
        .when(~F.col("is_git"), "Not a git repository")
        .when(F.coalesce("n_changed", F.lit(0)) == 0, "No changes detected")
        .when(F.coalesce("code", F.lit("")) == "", "Could not parse existing diagram")
        .when(F.coalesce("diff_text", F.lit("")) == "", "Could not generate diff")
        .when(pct > threshold * 100, "High impact - using full regeneration")
    )
    taken = reason.isNull()
    measured = taken | reason.startswith("High impact")
    return repos.select(
        "repo_id",
        F.when(taken, "incremental").otherwise("full").alias("mode"),
        F.coalesce(reason, F.lit("Low impact - using incremental update")).alias("reason"),
        F.when(taken, n).otherwise(0).cast("long").alias("affected"),
        F.when(taken, total).otherwise(0).cast("long").alias("total"),
        F.when(taken, pct).otherwise(0.0).alias("impact_pct"),
        F.when(taken, impact_level(total, pct)).otherwise("none").alias("impact_level"),
        F.when(measured, pct).alias("measured_pct"),
    )


def fleet_summary(decisions: DataFrame) -> DataFrame:
    """Runs and affected nodes per mode and level."""
    return decisions.groupBy("mode", "impact_level").agg(
        F.count(F.lit(1)).alias("repos"),
        F.sum("affected").cast("long").alias("affected"),
        F.avg("impact_pct").alias("mean_pct"),
    )
