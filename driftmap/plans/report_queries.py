"""Queries of the structure, token and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.functions.text import count_numbered_steps
from driftmap.operators import facts as A
from driftmap.operators import reports as R
from driftmap.plans import derived
from driftmap.plans.fact_queries import CONTEXT, FAULT, FAULTS, context, fleet, prose_files, without_fault_text
from driftmap.plans.oracle import sql
from driftmap.plans.registry import query

# Directories of the derived trees, each with its parents.
DIRS = """
    SELECT DISTINCT repo_id, unnest(CASE WHEN position('/' IN d) = 0 THEN [d]
      WHEN len(string_split(d, '/')) = 2 THEN [string_split(d, '/')[1], d]
      ELSE [string_split(d, '/')[1], string_split(d, '/')[1] || '/' || string_split(d, '/')[2], d] END) AS dir
    FROM (SELECT repo_id, CASE WHEN dir = 'src/.cache/' THEN 'src' ELSE rtrim(dir, '/') END AS d FROM files
      WHERE dir <> '' AND dir <> '.git/objects/')"""
TYPES = "SELECT repo_id, ext, count(*) AS files FROM files WHERE NOT hidden AND ext <> '' GROUP BY repo_id, ext"
SHAPE = f"""
    SELECT t.repo_id, total_files, coalesce(total_dirs, 0) AS total_dirs FROM
      (SELECT repo_id, count(*) AS total_files FROM files WHERE NOT hidden GROUP BY repo_id) t
      LEFT JOIN (SELECT repo_id, count(*) AS total_dirs FROM ({DIRS}) GROUP BY repo_id) d ON d.repo_id = t.repo_id"""
TOP = f"""
    SELECT repo_id, dir, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY dir) AS rank FROM ({DIRS})) WHERE rank <= 20"""
LANGUAGE = "CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' ELSE 'java' END"
ENTRIES = f"SELECT repo_id, path, {LANGUAGE} AS language FROM files WHERE doc_id % 11 = 0"


@query("agg1_structure", sql(SHAPE))
def agg1(spark, sf):
    return R.structure(derived.files(spark, sf))


@query("agg1_file_types", sql(TYPES))
def agg1_types(spark, sf):
    return R.file_types(derived.files(spark, sf))


@query("agg2_top_directories", sql(TOP))
def agg2(spark, sf):
    return R.top_dirs(derived.files(spark, sf))


@query("agg3_entry_points", sql(ENTRIES))
def agg3(spark, sf):
    return R.entry_points(derived.files(spark, sf))


@query("agg4_new_mode_report", sql(f"""
    SELECT repo_id, '1 totals' AS part, 1 AS rank, 'files' AS item, CAST(total_files AS VARCHAR) AS text FROM ({SHAPE})
    UNION ALL SELECT repo_id, '1 totals', 2, 'directories', CAST(total_dirs AS VARCHAR) FROM ({SHAPE})
    UNION ALL SELECT repo_id, '2 types', -files, ext, CAST(files AS VARCHAR) FROM ({TYPES})
    UNION ALL SELECT repo_id, '3 directories', rank, dir, '' FROM ({TOP})
    UNION ALL SELECT e.repo_id, '4 entry points', 0, e.path || ' (' || language || ')',
      CASE WHEN e.path LIKE '%.py' THEN '{FAULT}' ELSE content END
      FROM ({ENTRIES}) e JOIN files f ON f.repo_id = e.repo_id AND f.path = e.path
    UNION ALL SELECT repo_id, '4 entry points', 0, 'No standard entry points detected.', ''
      FROM (SELECT DISTINCT repo_id FROM files WHERE NOT hidden) WHERE repo_id NOT IN (SELECT repo_id FROM ({ENTRIES}))
    UNION ALL SELECT diagram_id, '1 totals', 1, 'files', CAST(count(*) AS VARCHAR) FROM parts GROUP BY diagram_id
    UNION ALL SELECT diagram_id, '1 totals', 2, 'directories', CAST(count(*) AS VARCHAR) FROM parts GROUP BY diagram_id
    UNION ALL SELECT diagram_id, '2 types', -count(*), '.py', CAST(count(*) AS VARCHAR) FROM parts GROUP BY diagram_id
    UNION ALL SELECT * FROM (SELECT diagram_id, '3 directories', row_number() OVER (PARTITION BY diagram_id ORDER BY 'p' || k) AS rank, 'p' || k, '' FROM parts)
      WHERE rank <= 20
    UNION ALL SELECT repo_id, '4 entry points', 0, replace(replace(path, 'src/', ''), '.py', '/main.py') || ' (python)', skeleton
      FROM (SELECT * FROM skeletons UNION ALL {FAULTS})"""))
def agg4(spark, sf):
    """Trees of documents, and repositories in which every part has a folder with a script to start."""
    scripts = derived.scripts(spark, sf).drop("k").withColumn("path", F.regexp_replace("path", r"^src/(p\d+)\.py$", "$1/main.py"))
    files = prose_files(spark, sf).unionByName(scripts)
    starts = files.filter(F.col("path").endswith("/main.py"))
    skeletons = A.render_skeleton(A.parse_files(starts))
    return R.new_mode_report(files, skeletons.withColumn("skeleton", without_fault_text(F.col("skeleton"))))


RAW = """SELECT repo_id, sum(chars) AS raw_chars FROM (
    SELECT repo_id, length('# STEP 1: load ' || p_name || '# ===== ' || p_type || ' =====' || 'bucket = os.getenv("BUCKET_' || k || '")'
        || 'limit = ' || p_size || '# keeps ' || p_name || ' sizes' || 'splitter = Splitter(chunk_size=' || p_size || ', chunk_overlap=2)'
        || '# TODO tune ' || k || 'meta = {"type": "' || p_type || '", "size": ' || p_size || '}' || 'label = "' || p_name || '"  # tail note ' || k
        || '    logging.info("part ' || k || ' ready")' || '    upload(bucket, label, "' || p_name || '", "0123456789012345678901234567890123456789")'
        || '    # long: ' || repeat('why ', 30) || p_name || 'pool = Pool(' || k || ', "' || p_name || '", "0123456789012345678901234567890123456789")'
        || 'import osif limit > 10:def run(x):    return helper(x)print(label)') + 17 AS chars FROM good_scripts
    UNION ALL SELECT diagram_id, length('def broken(:    pass') + 1 FROM parts WHERE k % 97 = 5
    UNION ALL SELECT repo_id, length('def broken(:') + 1 + length(content) FROM files WHERE ext = '.py') GROUP BY repo_id"""
TOOL = f"SELECT repo_id, sum(block_chars) AS tool_chars FROM ({CONTEXT}) GROUP BY repo_id"


@query("agg5_raw_tokens", sql(f"SELECT repo_id, CAST(raw_chars AS BIGINT) AS raw_chars, CAST(raw_chars // 4 AS BIGINT) AS raw_tokens FROM ({RAW})"))
def agg5(spark, sf):
    return R.raw_tokens(fleet(spark, sf))


@query("agg5_document_tokens", sql("""
    SELECT source AS repo_id, CAST(sum(length(text)) AS BIGINT) AS raw_chars, CAST(sum(length(text)) // 4 AS BIGINT) AS raw_tokens
    FROM documents GROUP BY source"""))
def agg5_documents(spark, sf):
    docs = derived.table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), F.lit("text").alias("path"), F.col("text").alias("content")
    )
    return R.raw_tokens(docs, "text")


@query("agg6_tool_tokens", sql(f"SELECT repo_id, CAST(tool_chars AS BIGINT) AS tool_chars, CAST(tool_chars // 4 AS BIGINT) AS tool_tokens FROM ({TOOL})"))
def agg6(spark, sf):
    return R.tool_tokens(context(spark, sf))


@query("agg7_savings", sql(f"""
    SELECT t.repo_id, CASE WHEN coalesce(r.raw_chars, 0) > 0 THEN (1 - (t.tool_chars / 4.0::DOUBLE) / (r.raw_chars / 4.0::DOUBLE)) * 100 ELSE 0.0 END AS saved_pct
    FROM ({TOOL}) t LEFT JOIN ({RAW}) r ON r.repo_id = t.repo_id"""))
def agg7(spark, sf):
    raw, tool = R.raw_tokens(fleet(spark, sf)), R.tool_tokens(context(spark, sf))
    return tool.join(raw, "repo_id", "left").select(
        "repo_id", R.savings(F.coalesce("raw_chars", F.lit(0)), F.col("tool_chars")).alias("saved_pct")
    )


def readmes(spark, sf):
    """Documents as read-me texts, some with a numbered list."""
    listed = F.concat(F.lit("1. first\n  2. second\nno 3. inside\n"), "text")
    return derived.table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), "doc_id",
        F.when(F.col("doc_id") % 5 == 0, listed).otherwise(F.col("text")).alias("content"),
    )


STEPS = r"""SELECT source AS repo_id, doc_id, len(regexp_extract_all(text, '(?m)^\s*\d+\.\s+')) + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS steps
    FROM documents"""


@query("agg8_readme_steps", sql(f"SELECT repo_id, CAST(sum(steps) AS BIGINT) AS readme_steps FROM ({STEPS}) GROUP BY repo_id"))
def agg8(spark, sf):
    return R.readme_steps(readmes(spark, sf))


@query("agg8_steps_per_document", sql(f"SELECT doc_id, CAST(steps AS INTEGER) AS steps FROM ({STEPS})"))
def agg8_each(spark, sf):
    return readmes(spark, sf).select("doc_id", count_numbered_steps(F.col("content")).alias("steps"))


@query("agg10_evaluation", sql(rf"""
    SELECT p.repo_id, CAST(coalesce(r.raw_chars, 0) // 4 AS BIGINT) AS raw_tokens, CAST(coalesce(t.tool_chars, 0) // 4 AS BIGINT) AS tool_tokens,
      CASE WHEN coalesce(r.raw_chars, 0) > 0 THEN (1 - (coalesce(t.tool_chars, 0) / 4.0::DOUBLE) / (r.raw_chars / 4.0::DOUBLE)) * 100 ELSE 0.0 END AS saved_pct,
      CAST(coalesce(s.steps, 0) AS BIGINT) AS readme_steps,
      coalesce(len(regexp_extract_all(d.code, '\w+\s*[\[\(\{{\<].*?[\]\)\}}\>]')), 0) AS diagram_steps
    FROM (SELECT DISTINCT repo_id, repo_id AS diagram_id FROM files UNION SELECT diagram_id, diagram_id FROM parts) p
    LEFT JOIN ({RAW}) r ON r.repo_id = p.repo_id
    LEFT JOIN ({TOOL}) t ON t.repo_id = p.repo_id
    LEFT JOIN (SELECT repo_id, sum(steps) AS steps FROM ({STEPS}) GROUP BY repo_id) s ON s.repo_id = p.repo_id
    LEFT JOIN diags d ON d.diagram_id = p.diagram_id"""))
def agg10(spark, sf):
    """Repositories of scripts have a diagram of their own name, those of documents a read-me."""
    files = fleet(spark, sf)
    repos = files.select("repo_id").distinct().withColumn("diagram_id", F.col("repo_id"))
    return R.evaluation(repos, files, context(spark, sf), readmes(spark, sf), derived.diagrams(spark, sf))
