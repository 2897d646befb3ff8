"""Queries of sources and sinks. Sinks write below the shared folder and are read back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from driftmap.operators import keyed
from driftmap.plans import derived
from driftmap.plans.ingest_queries import UNIFIED, unified
from driftmap.plans.oracle import sql
from driftmap.plans.registry import query
from driftmap.session import shared_dir
from driftmap.sources import changesets as S
from driftmap.sources import feeds as E
from driftmap.sources import pages as P
from driftmap.sources import reports as R
from driftmap.sources import tree as T
from driftmap.sources.tree_format import register


def put_files(files, base: str) -> None:
    """Write each content below ``base``/repo_id/path, in distributed steps; the files must not exist."""

    def put(batches):
        for batch in batches:
            n = 0
            for row in batch.to_pylist():
                fs, top = pafs.FileSystem.from_uri(base)
                full = f"{top}/{row['repo_id']}/{row['path']}"
                fs.create_dir(full.rpartition("/")[0])
                with fs.open_output_stream(full, compression=None) as f:
                    f.write(row["content"].encode())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    files.select("repo_id", "path", "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()


#: Every name that a listing may lose: a start file, a package, a hidden file, a hidden folder, a private one.
AWKWARD = "CASE doc_id % 5 WHEN 0 THEN '__init__.py' WHEN 1 THEN '.eslintrc.js' WHEN 2 THEN '_private/a.ts' WHEN 3 THEN '.git/x.java' ELSE '__main__.py' END"


@query("src1_scan_tree", sql(f"""
    SELECT repo_id, 'd' || doc_id || '/' || {AWKWARD} AS path, content, octet_length(encode(content)) AS n_bytes, true AS readable FROM files"""))
def src1(spark, sf):
    """Documents written as files of awkward names, then scanned again."""
    base = shared_dir(spark, "tree")
    put_files(derived.files(spark, sf).withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), F.expr(AWKWARD))), base)
    return T.scan_fleet(spark, base, T.SCAN_EXTENSIONS).select("repo_id", "path", "content", "n_bytes", "readable")


@query("src1_tree_format", sql(f"""
    SELECT repo_id, 'd' || doc_id || '/' || {AWKWARD} AS path, '.py' AS ext, content, octet_length(encode(content)) AS n_bytes, true AS readable
    FROM files WHERE doc_id % 5 IN (0, 4)"""))
def src1_format(spark, sf):
    """The same files through the data source, which reads only those of the extension asked for."""
    base = shared_dir(spark, "tree")
    put_files(derived.files(spark, sf).withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), F.expr(AWKWARD))), base)
    register(spark)
    return spark.read.format("source_tree").load(base).where(F.col("path").endswith(".py"))


@query("src2_prune_hidden", sql("SELECT repo_id, path FROM files WHERE NOT hidden"))
def src2(spark, sf):
    return T.prune_hidden(derived.files(spark, sf)).select("repo_id", "path")


@query("src3_ignore_rules", sql("""
    SELECT repo_id, path FROM files WHERE NOT (
      (repo_id <> 'src3' AND dir = 'docs/' AND NOT regexp_matches(base, '7\\.')) OR (repo_id <> 'src3' AND ext = '.md' AND NOT (dir = 'docs/' AND regexp_matches(base, '7\\.'))))"""))
def src3(spark, sf):
    files = derived.files(spark, sf)
    rule = F.struct
    listed = F.array(
        rule(F.lit(1).alias("seq"), F.lit("^docs/").alias("regex"), F.lit(False).alias("negated")),
        rule(F.lit(2).alias("seq"), F.lit(r"\.md$").alias("regex"), F.lit(False).alias("negated")),
        rule(F.lit(3).alias("seq"), F.lit(r"^docs/[^/]*7\.").alias("regex"), F.lit(True).alias("negated")),
    )
    rules = files.filter(F.col("repo_id") != "src3").select("repo_id").distinct().select("repo_id", F.inline(listed))
    return T.apply_ignore(files, rules).select("repo_id", "path")


@query("src4_extension_filter", sql("SELECT repo_id, path FROM files WHERE ext IN ('.py', '.js', '.ts', '.java')"))
def src4(spark, sf):
    return T.filter_ext(derived.files(spark, sf), T.SCAN_EXTENSIONS).select("repo_id", "path")


@query("src5_only_changed_paths", sql("SELECT repo_id, replace(path, '/', '\\') AS path FROM files WHERE doc_id % 6 = 1".replace("\\\\", "\\")))
def src5(spark, sf):
    files = derived.files(spark, sf)
    changed = files.filter(F.col("doc_id") % 6 == 1).select("repo_id", "path")
    windows = files.select("repo_id", F.replace("path", F.lit("/"), F.lit("\\")).alias("path"))
    return T.only_paths(windows, changed)


@query("src9_changeset_sink", sql("""
    SELECT change_id, CASE WHEN brand_no IN (2, 3, 4) THEN 0 ELSE n END AS n_changes,
      CASE WHEN brand_no = 2 THEN 'medium' WHEN brand_no = 3 THEN 'unknown' WHEN brand_no = 4 THEN 'none' ELSE 'low' END AS impact_assessment
    FROM (SELECT change_id, brand_no, CAST(count(*) AS INTEGER) AS n FROM ch GROUP BY ALL)"""))
def src9(spark, sf):
    path = shared_dir(spark, "changesets")
    sets = S.read_changesets(derived.replies(spark, sf))
    S.write_changesets(sets, path)
    return spark.read.schema(sets.schema).json(path).select("change_id", F.size("changes").alias("n_changes"), "impact_assessment")


def article_pages(spark, sf):
    """Documents as stored API responses of 50 articles; some feeds end early on an empty page."""
    d = F.col("doc_id")
    return (
        derived.table(spark, sf, "documents")
        .select(
            F.concat("lang", F.lit("-"), F.floor(d / 400).cast("string")).alias("feed"),
            F.floor((d % 400) / 50).alias("page"), "doc_id",
            F.struct(
                F.concat(F.lit("T"), d.cast("string")).alias("title"), F.col("text").alias("content"),
                F.lit("published").alias("status"), F.col("source").alias("url"), F.array("lang").alias("tags"),
            ).alias("article"),
        )
        .groupBy("feed", "page")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "article"))).alias("rows"))
        .select(
            "feed", "page",
            F.to_json(F.struct(
                F.when((F.col("page") == 5) & F.col("feed").startswith("en"), F.array().cast("array<" + E.ARTICLE + ">"))
                .otherwise(F.transform("rows", lambda r: r["article"])).alias("result")
            )).alias("body"),
        )
    )


@query("src10_paged_articles", sql("""
    SELECT feed, page, title, content, url FROM (
      SELECT lang || '-' || (doc_id // 400) AS feed, (doc_id % 400) // 50 AS page, 'T' || doc_id AS title, text AS content, source AS url, lang FROM documents) d
    WHERE NOT (lang = 'en' AND page >= 5 AND EXISTS (
      SELECT 1 FROM documents x WHERE x.lang = 'en' AND 'en-' || (x.doc_id // 400) = feed AND (x.doc_id % 400) // 50 = 5))"""))
def src10(spark, sf):
    path = shared_dir(spark, "articles")
    article_pages(spark, sf).write.json(path)
    return E.read_articles(E.read_pages(spark, path)).select("feed", "page", "title", "content", "url")


@query("src11_source_matrix", sql("""
    SELECT lang, url, url || 'lang=' || lang AS request FROM pages, (VALUES ('en'), ('fr')) l(lang)"""))
def src11(spark, sf):
    return E.source_matrix(derived.table(spark, sf, "pages").select("url"), ["en", "fr"])


@query("src12_combined_export", sql(f"SELECT doc_id, page_content, category, '2024-01-31' AS run_date FROM (SELECT page_title AS doc_id, * EXCLUDE (doc_id) FROM ({UNIFIED}))"))
def src12(spark, sf):
    path = shared_dir(spark, "combined")
    docs = unified(spark, sf)
    E.export_docs(docs, "2024-01-31", path)
    schema = docs.select("page_content", "metadata").schema
    return spark.read.schema(schema.add("run_date", "string")).json(path).select(
        F.col("metadata.page_title").alias("doc_id"), "page_content",
        F.array_join("metadata.category", ",").alias("category"), "run_date",
    )


@query("src13_csv_to_json", sql("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"))
def src13(spark, sf):
    base = shared_dir(spark, "csv")
    part = derived.table(spark, sf, "part")
    part.write.csv(f"{base}/csv", header=True, escape='"')
    E.csv_to_json(spark, f"{base}/csv", f"{base}/json", part.schema)
    return spark.read.schema(part.schema).json(f"{base}/json")


@query("src14_valid_pages", sql("""
    SELECT d.diagram_id, d.code FROM diags d JOIN (
      SELECT diagram_id FROM dl GROUP BY diagram_id HAVING count(*) FILTER (role = 'open') = count(*) FILTER (role = 'end')) v
    ON v.diagram_id = d.diagram_id"""))
def src14(spark, sf):
    path = shared_dir(spark, "pages")
    P.write_pages(derived.diagrams(spark, sf), path)
    return P.extract_diagrams(spark.read.parquet(path))


def runs(spark, sf):
    e = F.col("event_id")
    started = F.col("ts").cast("timestamp")
    return derived.table(spark, sf, "events").select(
        F.concat(F.lit("app"), (F.col("user_id") % 5).cast("string")).alias("application_name"),
        F.col("event_type").alias("job_name"),
        started.alias("started"),
        F.timestamp_micros(F.unix_micros(started) + (e % 977) * 1_000_003).alias("ended"),
        e.alias("num_embeddings"), (e % 10).alias("num_new_embeddings"), F.lit("input").alias("input_file"),
        F.lit("vectors").alias("output_type"), F.concat(F.lit("ns-"), e.cast("string")).alias("output_name"),
        F.when(e % 8 == 0, F.concat(F.lit("failed at "), e.cast("string"))).alias("error"),
    )


RUN_LOG = sql("""
    SELECT 'app' || (user_id % 5) AS application_name, event_type AS job_name, CAST((event_id % 977) * 1000003 // 1000000 AS INTEGER) AS duration_in_seconds,
      CASE WHEN event_id % 8 <> 0 THEN event_id END AS num_embeddings, CASE WHEN event_id % 8 <> 0 THEN event_id % 10 END AS num_new_embeddings,
      CASE WHEN event_id % 8 <> 0 THEN 'ns-' || event_id END AS output_name,
      CASE WHEN event_id % 8 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 8 = 0 THEN 'failed at ' || event_id END AS error
    FROM events""")


def log_columns(log):
    return log.select(
        "application_name", "job_name", "duration_in_seconds", "num_embeddings", "num_new_embeddings",
        F.col("output")[0]["name"].alias("output_name"), "status", "error",
    )


@query("src16_run_log_merged", RUN_LOG)
def src16_merged(spark, sf):
    """Runs are logged as failed first and then as they ended, some of them twice."""
    base = shared_dir(spark, "runs")
    done = runs(spark, sf).withColumn("run_id", F.col("num_embeddings"))
    broken = done.withColumn("error", F.lit("no answer yet"))
    for part in (broken, done, done.where("error IS NOT NULL")):
        rows = R.run_log_rows(part, "run_id")
        R.log_runs(rows, base)
    return log_columns(keyed.read(spark, base))


@query("src16_run_log", RUN_LOG)
def src16(spark, sf):
    path = shared_dir(spark, "runlog")
    rows = R.run_log_rows(runs(spark, sf))
    failed = F.col("status") == "failed"
    R.append_run_log(rows.filter(~failed), path)
    R.append_run_log(rows.filter(failed), path)
    return log_columns(spark.read.parquet(path))
