"""Queries of the source-file facts, on one derived script per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.functions.keywords import is_config_call, is_log_call
from driftmap.operators import facts as A
from driftmap.plans import derived
from driftmap.plans.oracle import CONFIG_PATTERN, sql
from driftmap.plans.registry import query


def parsed(spark, sf):
    return A.parse_files(derived.scripts(spark, sf))


@query("fct1_comments", sql("SELECT repo_id, path, line, text, type FROM noted"))
def fct1(spark, sf):
    return A.comments(derived.scripts(spark, sf)).drop("raw")


@query("fct1_document_comments", sql(r"""
    SELECT repo_id, path, line, text, CASE WHEN text LIKE '=%' OR text LIKE '-%' THEN 'section_header'
        WHEN regexp_matches(upper(text), '^(TODO|FIXME|HACK|XXX)') THEN 'todo'
        WHEN contains(substring(upper(text), 1, 20), 'STEP') THEN 'step_marker'
        WHEN length(text) > 100 THEN 'docstring' ELSE 'explanation' END AS type
    FROM (SELECT repo_id, path, line, trim(trim(raw, '#'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS text FROM (
      SELECT repo_id, path, line, regexp_extract(txt,
        '^(?:[^''"#]|"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*'')*(#.*)$', 1) AS raw
      FROM (SELECT repo_id, path, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line,
          unnest(string_split(content, chr(10))) AS txt FROM files)
      WHERE contains(txt, '#'))) WHERE text <> ''"""))
def fct1_documents(spark, sf):
    return A.comments(derived.files(spark, sf)).drop("raw")


@query("fct1_parsed_comments", sql("SELECT repo_id, path, line, text, type FROM noted"))
def fct1_parsed(spark, sf):
    return A.parsed_comments(parsed(spark, sf)).drop("raw")


@query("fct1_scanned_comments", sql(r"""
    SELECT repo_id, path, line, text, type FROM noted
    UNION ALL SELECT diagram_id, 'src/q' || k || '.py', s.line, s.text, s.type FROM (SELECT diagram_id, k, unnest([
      {'line': 1, 'text': 'yes ' || k, 'type': 'explanation'}, {'line': 4, 'text': 'STEP after ' || p_name, 'type': 'step_marker'},
      {'line': 5, 'text': 'TODO ' || k, 'type': 'todo'}, {'line': 6, 'text': 'raw', 'type': 'explanation'},
      {'line': 9, 'text': '= ' || p_type, 'type': 'section_header'}]) AS s FROM parts)"""))
def fct1_scanned(spark, sf):
    scripts = derived.scripts(spark, sf).select("repo_id", "path", "content")
    return A.scanned_comments(scripts.union(derived.quoted_scripts(spark, sf))).drop("raw")


@query("fct2_statement_facts", sql("SELECT repo_id, path, seq, line, indent, kind, text FROM stmts"))
def fct2(spark, sf):
    return A.statement_facts(parsed(spark, sf)).select("repo_id", "path", "seq", "line", "indent", "kind", "text")


@query("fct3_parse_failures", sql("""
    SELECT diagram_id AS repo_id, 'src/p' || k || '.py' AS path, true AS has_error FROM parts WHERE k % 97 = 5"""))
def fct3(spark, sf):
    return A.fact_errors(parsed(spark, sf)).select("repo_id", "path", (F.col("error") != "").alias("has_error"))


@query("fct4_attached_comments", sql("""
    SELECT s.repo_id, s.path, s.seq, s.line, n.line AS comment_line, n.text, n.type
    FROM stmts s JOIN takes t ON t.seq = s.seq
    JOIN noted n ON n.repo_id = s.repo_id AND n.path = s.path AND n.line = t.cline"""))
def fct4(spark, sf):
    return A.attach_comments(parsed(spark, sf))


@query("fct5_config_facts", sql("""
    SELECT diagram_id AS repo_id, 'src/p' || k || '.py' AS path, s.line, s.kind, s.key, s.value FROM (
      SELECT diagram_id, k, unnest([
        {'line': 4, 'kind': 'env', 'key': 'BUCKET_' || k, 'value': NULL},
        {'line': 5, 'kind': 'literal', 'key': 'limit', 'value': CAST(p_size AS VARCHAR)},
        {'line': 7, 'kind': 'literal', 'key': 'chunk_size', 'value': CAST(p_size AS VARCHAR)},
        {'line': 7, 'kind': 'literal', 'key': 'chunk_overlap', 'value': '2'},
        {'line': 10, 'kind': 'literal', 'key': 'label', 'value': p_name}]) AS s
      FROM parts WHERE k % 97 <> 5)"""))
def fct5(spark, sf):
    return A.config_facts(derived.scripts(spark, sf))


@query("fct6_config_inventory", sql("""
    SELECT key, count(*) AS uses, count(DISTINCT value) AS "values", count(DISTINCT repo_id) AS repos FROM (
      SELECT 'BUCKET_' || k AS key, NULL AS value, diagram_id AS repo_id FROM parts WHERE k % 97 <> 5
      UNION ALL SELECT 'limit', CAST(p_size AS VARCHAR), diagram_id FROM parts WHERE k % 97 <> 5
      UNION ALL SELECT 'chunk_size', CAST(p_size AS VARCHAR), diagram_id FROM parts WHERE k % 97 <> 5
      UNION ALL SELECT 'chunk_overlap', '2', diagram_id FROM parts WHERE k % 97 <> 5
      UNION ALL SELECT 'label', p_name, diagram_id FROM parts WHERE k % 97 <> 5) GROUP BY key"""))
def fct6(spark, sf):
    return A.config_inventory(A.config_facts(derived.scripts(spark, sf)))


@query("fct6_event_values", sql("""
    SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS uses, count(DISTINCT user_id) AS repos
    FROM events GROUP BY ALL"""))
def fct6_events(spark, sf):
    facts = derived.table(spark, sf, "events").select(
        F.col("user_id").alias("repo_id"), F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")
    )
    return A.config_values(facts)


# The fault of a broken script is worded by the Python release, so the checks leave its text out.
FAULT = "Error parsing script"
FAULTS = f"SELECT diagram_id AS repo_id, 'src/p' || k || '.py' AS path, '{FAULT}' AS skeleton FROM parts WHERE k % 97 = 5"


def without_fault_text(c):
    return F.when(c.contains(FAULT), F.regexp_replace(c, f"{FAULT}: [^\n]*", FAULT)).otherwise(c)


@query("fct7_skeletons", sql(f"SELECT repo_id, path, skeleton FROM skeletons UNION ALL {FAULTS}"))
def fct7(spark, sf):
    return A.render_skeleton(parsed(spark, sf)).withColumn("skeleton", without_fault_text(F.col("skeleton")))


@query("fct7_skeletons_plain", sql(f"""
    SELECT repo_id, path, string_agg(text, chr(10) ORDER BY seq) AS skeleton FROM stmts WHERE text IS NOT NULL GROUP BY repo_id, path
    UNION ALL {FAULTS}"""))
def fct7_plain(spark, sf):
    plain = A.render_skeleton(parsed(spark, sf), include_comments=False)
    return plain.withColumn("skeleton", without_fault_text(F.col("skeleton")))


NO_PYTHON = "def broken(:\n"


def prose_files(spark, sf):
    """Trees of documents. What they put into Python files is no Python, which its first line makes sure of."""
    prose = F.when(F.col("ext") == ".py", F.concat(F.lit(NO_PYTHON), "content")).otherwise(F.col("content"))
    return derived.files(spark, sf).drop("doc_id").withColumn("content", prose)


def fleet(spark, sf):
    """Files of both kinds of derived repository: trees of documents, and Python scripts of parts."""
    return prose_files(spark, sf).unionByName(derived.scripts(spark, sf).drop("k"))


def context(spark, sf):
    files = fleet(spark, sf)
    blocks = A.project_context(files, A.parse_files(files.filter(F.col("ext") == ".py")))
    told = blocks.withColumn("block", without_fault_text(F.col("block")))
    return told.withColumn("block_chars", F.length("block").cast("long"))


CONTEXT = f"""
    SELECT repo_id, path, block, length(block) AS block_chars FROM (
      SELECT repo_id, path, chr(10) || '--- FILE: ' || path || ' ---' || chr(10) || content || chr(10) AS block
      FROM files WHERE ext IN ('.js', '.ts', '.java')
      UNION ALL
      SELECT repo_id, path, chr(10) || '--- PIPELINE: ' || path || ' ---' || chr(10) || skeleton || chr(10) FROM (
        SELECT * FROM skeletons UNION ALL {FAULTS} UNION ALL SELECT repo_id, path, '{FAULT}' FROM files WHERE ext = '.py'))"""


@query("fct8_project_context", sql(CONTEXT))
def fct8(spark, sf):
    return context(spark, sf)


@query("fct8_context_size", sql(f"SELECT repo_id, CAST(sum(block_chars) AS BIGINT) AS total_chars FROM ({CONTEXT}) GROUP BY repo_id"))
def fct8_size(spark, sf):
    return A.context_size(context(spark, sf))


@query("prj6_config_calls", sql(f"""
    SELECT repo_id, path, seq, line FROM stmts WHERE kind IN ('CONFIG', 'ASSIGN', 'ACTION')
      AND (seq IN (0, 2) OR (seq = 7 AND regexp_matches(lower('bucket'), '{CONFIG_PATTERN}')))"""))
def prj6(spark, sf):
    facts = A.statement_facts(parsed(spark, sf))
    calls = F.col("kind").isin("CONFIG", "ASSIGN", "ACTION")
    return facts.filter(calls & is_config_call(F.col("arg_text"))).select("repo_id", "path", "seq", "line")


@query("prj7_log_calls", sql("SELECT repo_id, path, seq, line, kind FROM stmts WHERE seq IN (6, 11)"))
def prj7(spark, sf):
    facts = A.statement_facts(parsed(spark, sf))
    return facts.filter((F.col("node") == "call") & is_log_call(F.col("callee"))).select("repo_id", "path", "seq", "line", "kind")
