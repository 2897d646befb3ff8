"""Queries of the diagram operators, on diagrams derived from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.functions.keywords import with_keyword_tags
from driftmap.functions.text import computed
from driftmap.operators import diagram as D
from driftmap.operators.reports import heuristic_nodes
from driftmap.operators.dictionary import dictionary_tags
from driftmap.plans import derived
from driftmap.plans.oracle import sql
from driftmap.plans.registry import query
from driftmap.sources import pages as P


def lines(spark, sf):
    return D.diagram_lines(derived.diagrams(spark, sf))


def nodes(spark, sf):
    return D.diagram_nodes(D.node_definitions(lines(spark, sf)))


def edges(spark, sf):
    return D.diagram_edges(lines(spark, sf))


def members(spark, sf):
    return D.subgraph_members(lines(spark, sf))


@query("dia1_lines", sql("SELECT diagram_id, n, trim(txt) AS line FROM dl WHERE n > 0 AND trim(txt) <> '' AND trim(txt) NOT LIKE '\\%\\%%' ESCAPE '\\'"))
def dia1(spark, sf):
    return lines(spark, sf).select("diagram_id", "n", "line")


@query("dia2_scope", sql("SELECT diagram_id, n, sub AS scope FROM dl WHERE role IN ('node', 'open')"))
def dia2(spark, sf):
    body = F.col("line").rlike(r"[\[(]") & (F.col("kind") == "body")
    return lines(spark, sf).filter(body | (F.col("kind") == "subgraph")).select("diagram_id", "n", "scope")


@query("dia3_node_definitions", sql("SELECT diagram_id, n, node_id, ntype AS type, content, sub AS subgraph, raw_line FROM defs"))
def dia3(spark, sf):
    return D.node_definitions(lines(spark, sf)).drop("live")


@query("dia4_nodes_last_wins", sql("SELECT diagram_id, node_id, pos, type, content, subgraph, raw_line FROM nodes"))
def dia4(spark, sf):
    return nodes(spark, sf)


@query("dia5_edges", sql("SELECT diagram_id, seq, src, dst FROM edges"))
def dia5(spark, sf):
    return edges(spark, sf)


@query("dia6_metadata", sql("""
    SELECT d.diagram_id, 'flowchart TD' AS diagram_type, 'purpose' AS key, d.content AS value, d.n AS pos
    FROM dl d WHERE role = 'metadata'"""))
def dia6(spark, sf):
    d = derived.diagrams(spark, sf)
    return D.diagram_types(d).join(D.diagram_metadata(D.diagram_lines(d)), "diagram_id", "left")


@query("dia7_nested_form", sql("""
    SELECT t.diagram_id, 'flowchart TD' AS diagram_type, n.node_list, e.edge_list, s.subgraph_list, m.purpose
    FROM diags t
    LEFT JOIN (SELECT diagram_id, string_agg(node_id || ':' || type || ':' || coalesce(subgraph, '-'), ' ' ORDER BY pos) AS node_list
      FROM nodes GROUP BY diagram_id) n ON n.diagram_id = t.diagram_id
    LEFT JOIN (SELECT diagram_id, string_agg(src || '>' || dst, ' ' ORDER BY seq) AS edge_list FROM edges GROUP BY diagram_id) e
      ON e.diagram_id = t.diagram_id
    LEFT JOIN (SELECT diagram_id, string_agg(subgraph || '=' || coalesce(ids, ''), ' ' ORDER BY pos) AS subgraph_list FROM (
        SELECT o.diagram_id, o.subgraph, o.pos, string_agg(m.node_id, ',' ORDER BY m.pos) AS ids FROM opened o
        LEFT JOIN members m ON m.diagram_id = o.diagram_id AND m.subgraph = o.subgraph GROUP BY o.diagram_id, o.subgraph, o.pos)
      GROUP BY diagram_id) s ON s.diagram_id = t.diagram_id
    LEFT JOIN (SELECT diagram_id, content AS purpose FROM dl WHERE role = 'metadata') m ON m.diagram_id = t.diagram_id"""))
def dia7(spark, sf):
    d = derived.diagrams(spark, sf)
    nested = D.diagram_struct(d)

    def told(column, one):
        return F.array_join(F.transform(column, one), " ")

    return nested.select(
        "diagram_id", "diagram_type",
        told("nodes", lambda n: F.concat(n["node_id"], F.lit(":"), n["type"], F.lit(":"), F.coalesce(n["subgraph"], F.lit("-")))).alias("node_list"),
        told("edges", lambda e: F.concat(e["src"], F.lit(">"), e["dst"])).alias("edge_list"),
        told("subgraphs", lambda s: F.concat(s["subgraph"], F.lit("="), F.array_join(s["ids"], ","))).alias("subgraph_list"),
        F.col("metadata")["purpose"].alias("purpose"),
    )


@query("dia8_subgraph_members", sql("SELECT diagram_id, subgraph, node_id, pos FROM members"))
def dia8(spark, sf):
    return members(spark, sf)


@query("dia8_nodes_in_subgraph", sql("SELECT diagram_id, subgraph, node_id, pos FROM members WHERE subgraph = 'S_LARGE'"))
def dia8_in(spark, sf):
    return D.nodes_in(members(spark, sf), "S_LARGE")


@query("dia8_node_content", sql("SELECT diagram_id, content FROM nodes WHERE node_id = 'LONE'"))
def dia8_content(spark, sf):
    return D.node_content(nodes(spark, sf), "LONE")


@query("dia9_keyword_search", sql("SELECT diagram_id, node_id, content FROM nodes WHERE contains(lower(content), 'bucket')"))
def dia9(spark, sf):
    return D.find_nodes(nodes(spark, sf), "Bucket").select("diagram_id", "node_id", "content")


@query("dia10_rebuild", sql("""
    SELECT diagram_id, string_agg(txt, chr(10) ORDER BY part, x, y) AS code FROM (
      WITH shown AS (
        SELECT diagram_id, node_id, pos, CASE WHEN node_id LIKE 'P%7' THEN 'new ' || node_id ELSE content END AS c, type FROM nodes),
      told AS (
        SELECT *, CASE type WHEN 'cylinder' THEN node_id || '[("' || c || '")]' WHEN 'rounded' THEN node_id || '(' || c || ')'
          ELSE node_id || '["' || c || '"]' END AS t FROM shown),
      free AS (
        SELECT * FROM told t WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.diagram_id = t.diagram_id AND m.node_id = t.node_id))
      SELECT diagram_id, 0 AS part, 0 AS x, 0 AS y, 'flowchart TD' AS txt FROM diags
      UNION ALL SELECT diagram_id, 0, 0, 1, '' FROM diags
      UNION ALL SELECT diagram_id, 1, n, 0, '    purpose[' || content || ']' FROM dl WHERE role = 'metadata'
      UNION ALL SELECT diagram_id, 1, 1e9, 0, '' FROM dl WHERE role = 'metadata'
      UNION ALL SELECT diagram_id, 2, pos, 0, '    subgraph ' || subgraph FROM opened
      UNION ALL SELECT o.diagram_id, 2, o.pos, m.pos, '        ' || t.t FROM opened o
        JOIN members m ON m.diagram_id = o.diagram_id AND m.subgraph = o.subgraph
        JOIN told t ON t.diagram_id = m.diagram_id AND t.node_id = m.node_id
      UNION ALL SELECT diagram_id, 2, pos, 1e9, '    end' FROM opened
      UNION ALL SELECT diagram_id, 2, pos, 1e9 + 1, '' FROM opened
      UNION ALL SELECT diagram_id, 3, pos, 0, '    ' || t FROM free
      UNION ALL SELECT DISTINCT diagram_id, 3, 1e9, 0, '' FROM free
      UNION ALL SELECT diagram_id, 4, seq, 0, '    ' || src || ' --> ' || dst FROM edges)
    GROUP BY diagram_id"""))
def dia10(spark, sf):
    d = derived.diagrams(spark, sf)
    updates = (
        D.diagram_nodes(D.node_definitions(D.diagram_lines(d)))
        .filter(F.col("node_id").rlike("^P.*7$"))
        .select("diagram_id", "node_id", F.concat(F.lit("new "), "node_id").alias("content"))
    )
    return D.rebuild(d, updates)


@query("dia11_validate", sql("""
    SELECT diagram_id, opens = closes AS valid, CASE WHEN opens = closes THEN 'Valid'
      ELSE 'Unbalanced subgraphs: ' || opens || ' subgraph(s) vs ' || closes || ' end(s)' END AS reason
    FROM (SELECT diagram_id, count(*) FILTER (role = 'open') AS opens, count(*) FILTER (role = 'end') AS closes FROM dl GROUP BY diagram_id)"""))
def dia11(spark, sf):
    return D.validate(derived.diagrams(spark, sf))


@query("dia12_node_context", sql("""
    SELECT n.diagram_id, n.node_id, n.type, n.subgraph, coalesce(i.l, '') AS incoming, coalesce(o.l, '') AS outgoing, coalesce(t.l, '') AS tags
    FROM nodes n
    LEFT JOIN (SELECT diagram_id, dst, string_agg(src, ',' ORDER BY seq) AS l FROM edges GROUP BY ALL) i
      ON i.diagram_id = n.diagram_id AND i.dst = n.node_id
    LEFT JOIN (SELECT diagram_id, src, string_agg(dst, ',' ORDER BY seq) AS l FROM edges GROUP BY ALL) o
      ON o.diagram_id = n.diagram_id AND o.src = n.node_id
    LEFT JOIN (SELECT diagram_id, node_id, string_agg(tag, ',' ORDER BY tag) AS l FROM tags GROUP BY ALL) t
      ON t.diagram_id = n.diagram_id AND t.node_id = n.node_id"""))
def dia12(spark, sf):
    c = D.node_context(nodes(spark, sf), edges(spark, sf))
    return c.select(
        "diagram_id", "node_id", "type", "subgraph",
        *[F.array_join(x, ",").alias(x) for x in ("incoming", "outgoing", "tags")],
    )


@query("dia13_orphans", sql("SELECT diagram_id, node_id FROM nodes EXCEPT SELECT diagram_id, node_id FROM ends"))
def dia13(spark, sf):
    return D.orphans(nodes(spark, sf), edges(spark, sf))


@query("dia14_dangling", sql("SELECT diagram_id, node_id FROM ends EXCEPT SELECT diagram_id, node_id FROM nodes"))
def dia14(spark, sf):
    return D.dangling(nodes(spark, sf), edges(spark, sf))


@query("dia15_bullet_lint", sql("""
    SELECT diagram_id, node_id, len(string_split(content, '<br/>')) AS bullets FROM nodes
    WHERE len(string_split(content, '<br/>')) > 2"""))
def dia15(spark, sf):
    return D.bullet_lint(nodes(spark, sf), 2)


@query("dia16_locked_diff", sql("""
    SELECT coalesce(b.diagram_id, a.diagram_id) AS diagram_id, coalesce(b.node_id, a.node_id) AS item,
      CASE WHEN b.node_id IS NULL THEN 'node added' WHEN a.node_id IS NULL THEN 'node removed'
        WHEN a.subgraph IS DISTINCT FROM b.subgraph THEN 'node moved'
        WHEN b.node_id LIKE 'P%13' THEN 'expected change' ELSE 'unexpected change' END AS what
    FROM nodes b FULL JOIN (
      SELECT diagram_id, node_id, CASE WHEN node_id LIKE 'P%3' THEN content || '!' ELSE content END AS content,
        CASE WHEN node_id LIKE 'P%4' THEN 'Moved' ELSE subgraph END AS subgraph FROM nodes WHERE node_id NOT LIKE 'P%9'
      UNION ALL SELECT diagram_id, 'NEW', 'x', NULL FROM diags) a ON a.diagram_id = b.diagram_id AND a.node_id = b.node_id
    WHERE b.node_id IS NULL OR a.node_id IS NULL OR a.subgraph IS DISTINCT FROM b.subgraph OR a.content IS DISTINCT FROM b.content
    UNION ALL
    SELECT diagram_id, src || ' --> ' || dst, CASE WHEN sum(d) > 0 THEN 'edge added' ELSE 'edge removed' END FROM (
      SELECT diagram_id, src, dst, -1 AS d FROM edges
      UNION ALL SELECT diagram_id, src, dst, 1 FROM edges WHERE src NOT LIKE 'P%8'
      UNION ALL SELECT diagram_id, 'A', 'NEW', 1 FROM diags)
    GROUP BY diagram_id, src, dst HAVING sum(d) <> 0"""))
def dia16(spark, sf):
    d = derived.diagrams(spark, sf)
    rows = D.diagram_lines(d)
    before, was = D.diagram_nodes(D.node_definitions(rows)), D.diagram_edges(rows)
    name = F.col("node_id")
    new = d.select("diagram_id", F.lit("NEW").alias("node_id"), F.lit("x").alias("content"), F.lit(None).cast("string").alias("subgraph"))
    after = (
        before.filter(~name.like("P%9"))
        .select(
            "diagram_id", "node_id",
            F.when(name.like("P%3"), F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"),
            F.when(name.like("P%4"), "Moved").otherwise(F.col("subgraph")).alias("subgraph"),
        )
        .unionByName(new)
    )
    now = was.filter(~F.col("src").like("P%8")).select("diagram_id", "src", "dst").unionByName(
        d.select("diagram_id", F.lit("A").alias("src"), F.lit("NEW").alias("dst"))
    )
    return D.locked_diff(before, after, was, now, before.filter(name.like("P%13")))


@query("src6_diagram_from_page", sql("""
    SELECT diagram_id, code, length(code) AS chars FROM diags
    UNION ALL SELECT 'page ' || page_id, NULL, NULL FROM pages"""))
def src6(spark, sf):
    made = derived.diagrams(spark, sf).select("diagram_id", P.page_of(F.col("code")).alias("html"))
    other = derived.table(spark, sf, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("diagram_id"), "html")
    return P.extract_diagrams(made.unionByName(other)).withColumn("chars", F.length("code").cast("long"))


@query("agg9_heuristic_nodes", sql(r"""
    SELECT diagram_id, len(regexp_extract_all(code, '\w+\s*[\[\(\{\<].*?[\]\)\}\>]')) AS diagram_steps FROM diags"""))
def agg9(spark, sf):
    return heuristic_nodes(derived.diagrams(spark, sf))


@query("map1_node_tags", sql("SELECT diagram_id, node_id, tag FROM tags"))
def map1(spark, sf):
    return D.node_tags(nodes(spark, sf)).select("diagram_id", "node_id", F.explode(computed("tags")).alias("tag"))


@query("map1_large_dictionary", sql("""
    SELECT DISTINCT doc_id, unnest([word, upper(word[1])]) AS tag FROM documents
    JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark) ON contains(lower(text), word)"""))
def map1_large(spark, sf):
    """Every word of the benchmark is a keyword; its step is its first letter."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")
    words = derived.table(spark, sf, "benchmark").select(found).withColumn("step", F.upper(F.substring("word", 1, 1)))
    return dictionary_tags(derived.table(spark, sf, "documents").select("doc_id", "text"), words, "doc_id").select("doc_id", F.explode(computed("tags")).alias("tag"))


@query("map1_document_tags", sql("""
    SELECT DISTINCT doc_id, unnest([word, step]) AS tag FROM documents JOIN kw ON contains(lower(text), word)"""))
def map1_documents(spark, sf):
    return with_keyword_tags(derived.table(spark, sf, "documents"), "text").select("doc_id", F.explode(computed("tags")).alias("tag"))
