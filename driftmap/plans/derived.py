"""Inputs of the operators, derived by Spark from the given tables.

Diagrams come from parts, changes and diffs from events, source files from
documents and parts. Every one grows with its table. A diagram covers one
brand in a block of ``BLOCK`` part keys, so its size is bounded by that block
whatever share of all parts a brand has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmap.operators.changes import value_changes

BLOCK = 1_600

# Label words by part key, subgraph names by part type.
WORDS = ["chunk_size", "embedding model", "gcs bucket", "pickle cache", "namespace", "firestore", "read source", "transform"]
SUBGRAPHS = {
    "STANDARD": "Step1_Ingestion", "ECONOMY": "Step2_Chunking", "SMALL": "Step3_Embedding",
    "MEDIUM": "Step4_Storage", "LARGE": "S_LARGE", "PROMO": "S_PROMO",
}
# Setting and component by event type.
FIELDS = {"view": "chunk_size", "signup": "model", "error": "bucket", "click": "namespace", "purchase": "cache"}
COMPONENTS = {"view": "Chunking", "signup": "Embedding", "error": "Storage", "click": "Vector DB", "purchase": "Cache"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lookup(c: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def pick(c: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def diagram_id(brand: Column, partkey: Column) -> Column:
    return F.concat(brand, F.lit("/"), F.floor(partkey / BLOCK).cast("string"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """(k, diagram_id, brand_no, p_name, p_type, p_size, word, label)."""
    k = F.col("p_partkey")
    word = pick(k, WORDS)
    return table(spark, sf, "part").select(
        k.alias("k"),
        diagram_id(F.col("p_brand"), k).alias("diagram_id"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("brand_no"),
        "p_name", "p_type", "p_size", word.alias("word"),
        F.concat("p_name", F.lit("<br/> Step: "), word, F.lit("<br/> Size: "), F.col("p_size").cast("string")).alias("label"),
    )


# Fixed values: (condition, part, group, place, text) of each line a part row may give.
DIAGRAM_ROWS = [
    ("first", "0", "''", "0", "'flowchart TD'"),
    ("first", "1", "''", "0", "'    title(Fleet)'"),
    ("first", "1", "''", "1", "concat('    purpose[brand ', brand_no, ']')"),
    ("first", "1", "''", "2", "'    %% generated'"),
    ("first", "1", "''", "3", "''"),
    ("opens", "2", "grp", "-1", "concat('    subgraph ', grp)"),
    ("k % 3 = 0", "2", "grp", "k", """concat('        ', name, '[("', label, '")]')"""),
    ("k % 3 = 1", "2", "grp", "k", """concat('        ', name, '["', label, '"]')"""),
    ("k % 3 = 2", "2", "grp", "k", "concat('        ', name, '(', label, ')')"),
    ("opens", "2", "grp", "1099511627776", "'    end'"),
    ("k % 50 = 0", "3", "''", "k", """concat('    ', name, '["redefined ', k, '"]')"""),
    ("first AND brand_no % 6 = 0", "4", "''", "0", """'    LONE["lone note<br/>a<br/>b<br/>c<br/>d"]'"""),
    ("first AND brand_no % 5 = 0", "5", "''", "0", "'    subgraph S_LARGE'"),
    ("first AND brand_no % 5 = 0", "5", "''", "1", """'        RE1["entered again"]'"""),
    ("first AND brand_no % 5 = 0", "5", "''", "2", "'    end'"),
    ("next IS NOT NULL", "6", "''", "k", "concat('    ', name, ' --> P', next)"),
    ("first AND brand_no % 4 = 0", "6", "''", "-1", "concat('    Step2_Chunking --> ', name)"),
    ("first AND brand_no % 8 = 0", "6", "''", "-2", "concat('    ', name, ' -->|odd| ', name)"),
    ("first AND brand_no = 3", "7", "''", "0", "'    subgraph Broken'"),
]


def diagrams(spark: SparkSession, sf: str) -> DataFrame:
    """(diagram_id, code): flowchart text with every parsing trap in it. One shuffle by diagram."""
    by_diagram = Window.partitionBy("diagram_id").orderBy("k")
    by_type = Window.partitionBy("diagram_id", "p_type").orderBy("k")
    placed = (
        parts(spark, sf)
        .withColumn("next", F.lead("k").over(by_diagram))
        .withColumn("first", F.row_number().over(by_diagram) == 1)
        .withColumn("opens", F.row_number().over(by_type) == 1)
        .withColumn("grp", lookup(F.col("p_type"), SUBGRAPHS))
        .withColumn("name", F.expr("concat('P', k)"))
    )
    rows = ", ".join(
        f"CASE WHEN {when} THEN named_struct('a', {a}, 'g', {g}, 'at', CAST({at} AS BIGINT), 'text', {text}) END"
        for when, a, g, at, text in DIAGRAM_ROWS
    )
    return (
        placed.selectExpr("diagram_id", f"explode(array_compact(array({rows}))) AS r")
        .groupBy("diagram_id")
        .agg(F.expr("array_join(transform(sort_array(collect_list(r)), r -> r.text), '\n')").alias("code"))
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """(diagram_id, change_id, brand_no, day, field, component, event_id, ts, k, value): settings over time."""
    events = table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").alias("value"),
        F.floor(F.col("event_id") / 5).alias("k"),
    )
    owner = parts(spark, sf).select("k", "diagram_id", "brand_no")
    # the part keys are 0, 1, ...; events beyond five a part go round again
    parts_in_all = (owner.agg(F.max("k")).first()[0] or 0) + 1
    events = events.withColumn("k", F.pmod("k", F.lit(parts_in_all)))
    return events.join(owner, "k").select(
        "diagram_id", "brand_no", "event_id", "ts", "k", "value", "user_id",
        F.concat("diagram_id", F.lit("@"), F.col("ts").cast("date").cast("string")).alias("change_id"),
        F.dayofmonth("ts").alias("day"),
        lookup(F.col("event_type"), FIELDS).alias("field"),
        lookup(F.col("event_type"), COMPONENTS).alias("component"),
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Setting changes, each with component, suggestion list, old and new value."""
    e = F.col("event_id")
    suggestion = (
        F.when(e % 3 == 0, F.array(F.concat(F.lit("P"), F.col("k").cast("string"))))
        .when(e % 7 == 0, F.array(F.lit("lone_note"), F.lit("text_splitting")))
        .otherwise(F.array(F.lit("text_splitting")))
    )
    return value_changes(history(spark, sf), ["diagram_id", "field"], bucket_seconds=86_400).withColumn(
        "affected_nodes", suggestion
    )


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    """(change_id, diagram_id, diff_text): one day of changes of a diagram as diff text."""
    e, field = F.col("event_id"), F.col("field")
    file = F.concat(field, F.lit("_"), (e % 4).cast("string"), F.when(e % 11 == 0, ".md").otherwise(".py"))
    new = F.when(e % 7 == 0, F.concat(F.lit('"'), "new_value", F.lit('"'))).otherwise(F.col("new_value"))
    text = F.concat(
        F.lit("diff --git a/src/"), file, F.lit(" b/src/"), file,
        F.when(F.col("old_value") != "N/A", F.concat(F.lit("\n-"), field, F.lit(" = "), "old_value")).otherwise(""),
        F.lit("\n+"), field, F.lit(" = "), new,
        F.when(e % 5 == 0, F.concat(F.lit("\n+def load_"), (e % 3).cast("string"), F.lit("(x):"))).otherwise(""),
    )
    return (
        changes(spark, sf)
        .groupBy("change_id", "diagram_id")
        .agg(F.array_sort(F.collect_list(F.struct("event_id", text.alias("text")))).alias("rows"))
        .select("change_id", "diagram_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("diff_text"))
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """(change_id, diagram_id, diff_text, reply): change sets as JSON, some fenced, partial, broken or absent."""
    c = (
        changes(spark, sf)
        .groupBy("change_id", "diagram_id", "brand_no")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(
                    "event_id", "component", F.lit("config_update").alias("type"), "field", "old_value", "new_value",
                    F.lit("").alias("impact"), "affected_nodes",
                ))),
                lambda r: F.struct(
                    r["component"].alias("component"), r["type"].alias("type"), r["field"].alias("field"),
                    r["old_value"].alias("old_value"), r["new_value"].alias("new_value"), r["impact"].alias("impact"),
                    r["affected_nodes"].alias("affected_nodes"),
                ),
            ).alias("changes")
        )
    )
    b = F.col("brand_no")
    whole = F.to_json(F.struct(
        "changes", F.concat(F.lit("day of "), "diagram_id").alias("summary"),
        F.array(F.lit("src/a.py")).alias("changed_files"), F.lit("low").alias("impact_assessment"),
    ))
    reply = (
        F.when(b == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(b == 2, F.lit('{"other": 1}'))
        .when(b == 3, F.concat(F.lit('{"changes": ['), "change_id"))
        .otherwise(whole)
    )
    return c.select(
        "change_id", "diagram_id", F.when(b == 4, "  \n ").otherwise(F.col("diagram_id")).alias("diff_text"),
        reply.alias("reply"),
    )


# Where derived files lie, and their extensions.
DIRECTORIES = [".git/objects/", "src/.cache/", "src/app/", "src/lib/util/", "docs/", "", "tests/unit/"]
EXTENSIONS = [".py", ".js", ".ts", ".java", ".go", ".rb", ".md", ".json", ""]
STARTERS = ["main.py", "index.js", "app.ts", "Main.java"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(repo_id, path, ext, content, doc_id): documents laid out as source trees, one per source."""
    d = F.col("doc_id")
    folder = F.when(d % 8 < 7, pick(d % 8, DIRECTORIES)).otherwise(
        F.concat(F.lit("pkg/m"), (d % 50).cast("string"), F.lit("/"))
    )
    ext = pick(d, EXTENSIONS)
    path = (
        F.when(d % 11 == 0, F.concat(F.lit("svc"), d.cast("string"), F.lit("/"), pick(F.floor(d / 11), STARTERS)))
        .when(d % 13 == 0, F.concat(folder, F.lit(".env"), d.cast("string")))
        .otherwise(F.concat(folder, F.lit("f"), d.cast("string"), ext))
    )
    from driftmap.sources.tree import extension

    return table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), path.alias("path"), extension(path).alias("ext"),
        F.col("text").alias("content"), "doc_id",
    )


def spread_parts(spark: SparkSession, sf: str) -> DataFrame:
    """``parts``, dealt by key: a part table is small enough to be one task's, what is made of its rows is not."""
    return parts(spark, sf).repartition("k")


# The lines of a derived script.
SCRIPT_ROWS = [
    "concat('# STEP 1: load ', p_name)",
    "'import os'",
    "concat('# ===== ', p_type, ' =====')",
    """concat('bucket = os.getenv("BUCKET_', k, '")')""",
    "concat('limit = ', p_size)",
    "concat('# keeps ', p_name, ' sizes')",
    "concat('splitter = Splitter(chunk_size=', p_size, ', chunk_overlap=2)')",
    "concat('# TODO tune ', k)",
    """concat('meta = {"type": "', p_type, '", "size": ', p_size, '}')""",
    """concat('label = "', p_name, '"  # tail note ', k)""",
    "'if limit > 10:'",
    """concat('    logging.info("part ', k, ' ready")')""",
    """concat('    upload(bucket, label, "', p_name, '", "0123456789012345678901234567890123456789")')""",
    "'def run(x):'",
    "concat('    # long: ', repeat('why ', 30), p_name)",
    "'    return helper(x)'",
    """concat('pool = Pool(', k, ', "', p_name, '", "0123456789012345678901234567890123456789")')""",
    "'print(label)'",
]


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """(repo_id, path, ext, content, k): one Python source per part, some of them broken."""
    rows = ", ".join(SCRIPT_ROWS)
    return spread_parts(spark, sf).selectExpr(
        "diagram_id AS repo_id",
        "concat('src/p', k, '.py') AS path",
        "'.py' AS ext",
        f"CASE WHEN k % 97 = 5 THEN 'def broken(:\\n    pass' ELSE concat_ws('\\n', {rows}) END AS content",
        "k",
    )


# Fixed value: a script with every kind of string around a number sign.
QUOTED = """\
a = "x # no" # yes <k>
b = \'\'\'first # no
second # no \\\'\'\' still # no
\'\'\' # STEP after <name>
c = \'it\\\'s # no\'  # TODO <k>
d = r"\\" # no"  # raw
\"\"\"# doc
# inside "" \"\"\"
# = <type>"""


def quoted_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """(repo_id, path, content): one more Python source per part, full of strings."""
    content = F.lit(QUOTED)
    for mark, value in (("<k>", F.col("k").cast("string")), ("<name>", F.col("p_name")), ("<type>", F.col("p_type"))):
        content = F.replace(content, F.lit(mark), value)
    path = F.concat(F.lit("src/q"), F.col("k").cast("string"), F.lit(".py"))
    return spread_parts(spark, sf).select(F.col("diagram_id").alias("repo_id"), path.alias("path"), content.alias("content"))


def headed_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page_content, title, lang): documents with heading lines put in."""
    d = F.col("doc_id")
    body = F.when(
        d % 3 == 0,
        F.concat("text", F.lit("\n## S"), d.cast("string"), F.lit("\n### kept inside\n"), "text"),
    ).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("# T"), d.cast("string"), F.lit("\n"), body).alias("page_content"),
        F.concat(F.lit("T"), d.cast("string")).alias("title"), "lang", "source",
    )


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(base, head): the same trees before and after additions, removals and edits."""
    f = files(spark, sf)
    base = f.filter(F.col("doc_id") % 17 != 0)
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    head = f.filter(F.col("doc_id") % 19 != 0).withColumn("content", edited)
    return base, head
