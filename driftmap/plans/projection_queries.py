"""Queries of the row-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.functions import text as T
from driftmap.operators import diagram as D
from driftmap.operators import impact as I
from driftmap.operators import ingest as G
from driftmap.operators import requests as Q
from driftmap.operators.changes import cut_diff
from driftmap.plans import derived
from driftmap.plans.oracle import sql
from driftmap.plans.registry import query


@query("prj1_truncate", sql("""
    SELECT doc_id, substring(text, 1, 2000) AS preview,
      CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS args,
      CASE WHEN length(text) > 15000 THEN substring(text, 1, 15000) || chr(10) || chr(10) || '... (diff truncated for length)' ELSE text END AS diff
    FROM documents"""))
def prj1(spark, sf):
    text = F.col("text")
    return derived.table(spark, sf, "documents").select(
        "doc_id", T.truncate(text, 2_000).alias("preview"), T.truncate(text, 50, "...").alias("args"), cut_diff(text, 15_000).alias("diff")
    )


@query("prj2_drop_blank", sql("SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0"))
def prj2(spark, sf):
    docs = derived.table(spark, sf, "documents").withColumn(
        "body", F.when(F.col("doc_id") % 14 == 0, " \t\n").when(F.col("doc_id") % 7 != 0, F.col("text"))
    )
    return G.drop_blank(docs, "body").select("doc_id", "n_chars")


def tagged_docs(spark, sf):
    """Documents with tags from their labels, a status and a URL."""
    labels = derived.table(spark, sf, "labels").select(
        "doc_id",
        F.array_compact(F.array(
            F.when(F.col("quality") == 1, F.lit("Good")), F.when(F.col("toxic") == 1, F.lit("Toxic"))
        )).alias("tags"),
    )
    d = F.col("doc_id")
    return (
        derived.table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .withColumn("status", F.when(d % 4 == 0, "draft").otherwise("published"))
        .withColumn("url", F.concat(F.lit("/"), "source", F.lit("/"), d.cast("string")))
    )


@query("prj3_published", sql("""
    SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    WHERE (l.quality = 1 OR l.toxic = 1) AND d.doc_id % 4 <> 0 AND NOT contains('/' || source || '/' || d.doc_id, 'src1/')"""))
def prj3(spark, sf):
    return G.published(tagged_docs(spark, sf), "src1/").select("doc_id")


@query("prj4_tagged_untagged", sql("""
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'untagged' ELSE 'tagged' END AS side FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id"""))
def prj4(spark, sf):
    tagged, untagged = G.split_on_key(tagged_docs(spark, sf), "tags")
    return tagged.select("doc_id", F.lit("tagged").alias("side")).unionByName(
        untagged.select("doc_id", F.lit("untagged").alias("side"))
    )


@query("prj5_quality", sql(r"""
    SELECT conv_id, turn, part FROM (SELECT conv_id, turn, unnest(string_split(text, '.')) AS part FROM conversations)
    WHERE length(part) > 10 AND len(list_distinct(string_split(part, ''))) > 2"""))
def prj5(spark, sf):
    parts = derived.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\.")).alias("part"))
    return parts.filter(T.passes_quality(F.col("part")))


@query("prj9_clean_reply", sql(r"""
    SELECT conv_id, turn, regexp_replace(chr(10) || text || chr(10), '[^\x00-\x7F]', '', 'g') AS cleaned FROM conversations"""))
def prj9(spark, sf):
    fenced = F.concat(F.lit("```mermaid\n"), "text", F.lit("\n```"))
    return derived.table(spark, sf, "conversations").select("conv_id", "turn", T.clean_diagram_reply(fenced).alias("cleaned"))


@query("prj10_metadata_block", sql(f"""
    SELECT k, CASE WHEN k % 30 = 0 THEN '' ELSE chr(10) || '    {Q.METADATA_HEADER}' || chr(10)
      || concat_ws(chr(10), CASE WHEN k % 2 <> 0 THEN '    - Pipeline Name: ' || p_name END,
        CASE WHEN k % 3 <> 0 THEN '    - Data Type: ' || p_type END, CASE WHEN k % 5 <> 0 THEN '    - Owner: ' || diagram_id END)
      || chr(10) END AS block FROM parts"""))
def prj10(spark, sf):
    k = F.col("k")
    return derived.parts(spark, sf).select("k", Q.metadata_block({
        "name": F.when(k % 2 != 0, F.col("p_name")), "data_type": F.when(k % 3 != 0, F.col("p_type")),
        "owner": F.when(k % 5 != 0, F.col("diagram_id")).otherwise(""),
    }).alias("block"))


@query("prj11_update_requests", sql("""
    SELECT r.change_id, r.diagram_id, md5(d.code) AS diagram_md5, coalesce(a.ids, 'None detected') AS affected_nodes,
      coalesce(a.details, '') AS node_details, r.diff_text AS diff_start
    FROM diffs r JOIN diags d ON d.diagram_id = r.diagram_id
    LEFT JOIN (
      SELECT change_id, string_agg(node_id, ', ' ORDER BY node_id) AS ids, string_agg(detail, '' ORDER BY node_id) AS details FROM (
        SELECT x.change_id, x.node_id, chr(10) || '  Node ' || x.node_id || ':'
          || chr(10) || '    - Current Content: ' || n.content
          || chr(10) || '    - Subgraph: ' || coalesce(n.subgraph, 'None')
          || chr(10) || '    - Keywords: ' || coalesce(t.l, '')
          || chr(10) || '    - Connected to: ' || concat_ws(', ', i.l, o.l) AS detail
        FROM affected x JOIN nodes n ON n.diagram_id = x.diagram_id AND n.node_id = x.node_id
        LEFT JOIN (SELECT diagram_id, node_id, string_agg(tag, ', ' ORDER BY tag) AS l FROM tags GROUP BY ALL) t
          ON t.diagram_id = n.diagram_id AND t.node_id = n.node_id
        LEFT JOIN (SELECT diagram_id, dst, string_agg(src, ', ' ORDER BY seq) AS l FROM edges GROUP BY ALL) i
          ON i.diagram_id = n.diagram_id AND i.dst = n.node_id
        LEFT JOIN (SELECT diagram_id, src, string_agg(dst, ', ' ORDER BY seq) AS l FROM edges GROUP BY ALL) o
          ON o.diagram_id = n.diagram_id AND o.src = n.node_id)
      GROUP BY change_id) a ON a.change_id = r.change_id"""))
def prj11(spark, sf):
    d = derived.diagrams(spark, sf)
    lines = D.diagram_lines(d)
    nodes = D.diagram_nodes(D.node_definitions(lines))
    affected = I.affected_nodes(I.change_wants(derived.changes(spark, sf)), I.diagram_profile(d))
    runs = derived.diffs(spark, sf).withColumn("metadata", F.lit(""))
    out = Q.build_requests(runs, affected, D.node_context(nodes, D.diagram_edges(lines)), d)
    return out.select(
        "change_id", "diagram_id", F.md5("existing_diagram").alias("diagram_md5"), "affected_nodes", "node_details", "diff_start"
    )
