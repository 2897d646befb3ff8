"""Flowchart text to line, node, edge, subgraph and metadata tables, and back.

A diagram is one row of text. Splitting it, finding the subgraph each line is
in and recognising nodes and edges are projections, so a fleet of diagrams is
read without a shuffle. Only the last-definition-wins step groups, by
(diagram, node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.functions.keywords import with_keyword_tags
from driftmap.functions.text import is_blank, strip

# Node shapes in the order they are tried; group 1 id, group 2 label.
NODE_PATTERNS = [
    r'(?dU)(\w+)\["(.*?)"\]',
    r'(?dU)(\w+)\[\("(.*?)"\)\]',
    r"(?dU)(\w+)\[\((.*?)\)\]",
    r"(?dU)(\w+)\[(.*?)\]",
    r"(?dU)(\w+)\((.*?)\)",
]
ANY_SQUARE, ANY_ROUND = NODE_PATTERNS[3], NODE_PATTERNS[4]  # the widest shapes: some shape fits if one of them does
EDGE_PATTERN = r"(?dU)(\w+)(?:\[.*?\])?\s*(?:-->|---)\s*(\w+)"
SUBGRAPH_PATTERN = r"(?U)^subgraph\s+(\w+)"
METADATA_STARTS = ["title(", "purpose[", "note["]
METADATA_PATTERN = r"(?dU)^(\w+)\[(.*?)\]"


def _starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def all_lines(diagrams: DataFrame) -> DataFrame:
    """(diagram_id, n, line, scope, scope_n, scope_pos, live, kind), header line included.

    ``scope`` is the subgraph the line stands in, ``scope_n`` the line that
    opened it, ``scope_pos`` the first line that opened that name, and ``live``
    whether the name is never opened again. The scope is one variable, not a
    stack: any ``end`` clears it.
    """
    split = diagrams.select(
        "diagram_id",
        F.transform(
            F.split(strip(F.col("code")), "\n"),
            lambda line, i: F.struct(i.alias("n"), strip(line).alias("line")),
        ).alias("rows"),
    )
    # The places where the scope changes, each with the scope it sets.
    marked = split.select(
        "diagram_id",
        "rows",
        F.transform(
            F.filter(
                "rows", lambda x: (x["n"] > 0) & ((x["line"] == "end") | x["line"].rlike(SUBGRAPH_PATTERN))
            ),
            lambda x: F.struct(F.regexp_extract(x["line"], SUBGRAPH_PATTERN, 1).alias("scope"), x["n"].alias("n")),
        ).alias("marks"),
    )
    # Sorted by name, an opening is the last of its name where the next name differs.
    ranked = marked.select(
        "diagram_id", "rows", "marks", F.array_sort("marks").alias("sorted"),
        F.transform("marks", lambda m: m["scope"]).alias("names"),
    )
    spans = ranked.select(
        "diagram_id", "rows", "marks", "names",
        F.transform(
            F.filter(
                F.zip_with(
                    "sorted", F.slice("sorted", 2, F.size("sorted")),
                    lambda m, after: F.struct(m["n"].alias("n"), m["scope"].alias("scope"), after["scope"].alias("after")),
                ),
                lambda m: ~m["scope"].eqNullSafe(m["after"]),
            ),
            lambda m: m["n"],
        ).alias("last_openings"),
        F.concat(
            F.array(F.struct(F.lit("").alias("scope"), F.lit(0).alias("n"))), "marks"
        ).alias("starts"),
        F.concat(F.transform("marks", lambda m: m["n"]), F.array(F.size("rows"))).alias("stops"),
    ).select(
        "diagram_id", "rows", "marks", "names", "last_openings",
        F.explode(
            F.zip_with(
                "starts", "stops",
                lambda m, stop: F.struct(m["scope"].alias("scope"), m["n"].alias("start"), stop.alias("stop")),
            )
        ).alias("span"),
    )
    scope, start = F.col("span.scope"), F.col("span.start")
    first_mark = F.array_position("names", scope).cast("int")
    lines = spans.select(
        "diagram_id",
        F.nullif(scope, F.lit("")).alias("scope"),
        F.when(scope != "", start).alias("scope_n"),
        F.when(scope != "", F.element_at("marks", F.greatest(first_mark, F.lit(1)))["n"]).alias("scope_pos"),
        ((scope != "") & F.array_contains("last_openings", start)).alias("live"),
        F.explode(F.slice("rows", start + 1, F.col("span.stop") - start)).alias("l"),
    ).select(
        "diagram_id", F.col("l.n").alias("n"), F.col("l.line").alias("line"), "scope", "scope_n", "scope_pos", "live"
    )
    line = F.col("line")
    kind = (
        F.when(F.col("n") == 0, "type")
        .when(line.startswith("subgraph"), "subgraph")
        .when(line == "end", "end")
        .when(_starts_with_any(line, METADATA_STARTS), "metadata")
        .otherwise("body")
    )
    return lines.withColumn("kind", kind).filter(
        (F.col("n") == 0) | ((line != "") & ~line.startswith("%%"))
    )


def diagram_lines(diagrams: DataFrame) -> DataFrame:
    """One row per meaningful line; line 0 is never content, blank and ``%%`` lines are none.

    ``kind`` is subgraph, end, metadata or body.
    """
    return all_lines(diagrams).filter(F.col("n") > 0)


def _first_node() -> Column:
    """Id and label of the first node on a line, by the first shape that fits."""
    line = F.col("line")
    return F.coalesce(
        *[
            F.when(
                line.rlike(p),
                F.struct(F.regexp_extract(line, p, 1).alias("node_id"), F.regexp_extract(line, p, 2).alias("content")),
            )
            for p in NODE_PATTERNS
        ]
    )


def _shape() -> Column:
    line = F.col("line")
    return (
        F.when(line.contains("[("), "cylinder")
        .when(line.contains("(") & ~line.contains("["), "rounded")
        .otherwise("rect")
    )


def _may_hold_node() -> Column:
    return (F.col("kind") == "body") & (F.col("line").contains("[") | F.col("line").contains("("))


def _may_hold_edge() -> Column:
    return (F.col("kind") == "body") & (F.col("line").contains("-->") | F.col("line").contains("---"))


def node_definitions(lines: DataFrame) -> DataFrame:
    """Every node definition: the first node of a body line."""
    return (
        lines.filter(_may_hold_node() & (F.col("line").rlike(ANY_SQUARE) | F.col("line").rlike(ANY_ROUND)))
        .withColumn("found", _first_node())
        .select(
            "diagram_id", "n", F.col("found.node_id").alias("node_id"), _shape().alias("type"),
            F.col("found.content").alias("content"), F.col("scope").alias("subgraph"), "live",
            F.col("line").alias("raw_line"),
        )
    )


def diagram_nodes(definitions: DataFrame) -> DataFrame:
    """One row per node: the last definition wins, the first position stays."""
    last = F.max_by(F.struct("type", "content", "subgraph", "raw_line"), "n").alias("d")
    return (
        definitions.groupBy("diagram_id", "node_id")
        .agg(F.min("n").alias("pos"), last)
        .select("diagram_id", "node_id", "pos", "d.type", "d.content", "d.subgraph", "d.raw_line")
    )


def diagram_edges(lines: DataFrame) -> DataFrame:
    """The first edge of each body line; ends need not be nodes."""
    line = F.col("line")
    return (
        lines.filter(_may_hold_edge() & line.rlike(EDGE_PATTERN))
        .select(
            "diagram_id", F.col("n").alias("seq"),
            F.regexp_extract(line, EDGE_PATTERN, 1).alias("src"),
            F.regexp_extract(line, EDGE_PATTERN, 2).alias("dst"),
        )
    )


def diagram_types(diagrams: DataFrame) -> DataFrame:
    head = strip(F.split(strip(F.col("code")), "\n")[0])
    known = head.startswith("flowchart") | head.startswith("graph")
    return diagrams.select("diagram_id", F.when(known, head).otherwise("").alias("diagram_type"))


def diagram_metadata(lines: DataFrame) -> DataFrame:
    """key[value] metadata lines, last value per key; ``title(x)`` carries none."""
    line = F.col("line")
    return (
        lines.filter((F.col("kind") == "metadata") & line.rlike(METADATA_PATTERN))
        .select(
            "diagram_id", "n",
            F.regexp_extract(line, METADATA_PATTERN, 1).alias("key"),
            F.regexp_extract(line, METADATA_PATTERN, 2).alias("value"),
        )
        .groupBy("diagram_id", "key")
        .agg(F.min("n").alias("pos"), F.max_by("value", "n").alias("value"))
    )


def subgraphs(lines: DataFrame) -> DataFrame:
    """(diagram_id, subgraph, pos): each name at its first opening."""
    return lines.filter((F.col("kind") == "subgraph") & (F.col("scope_pos") == F.col("n"))).select(
        "diagram_id", F.col("scope").alias("subgraph"), F.col("n").alias("pos")
    )


def subgraph_members(lines: DataFrame) -> DataFrame:
    """Members of a subgraph: every definition since it was last opened, repeats kept."""
    return node_definitions(lines).filter("live").select("diagram_id", "subgraph", "node_id", F.col("n").alias("pos"))


def nodes_in(members: DataFrame, subgraph: str) -> DataFrame:
    return members.filter(F.col("subgraph") == subgraph)


def node_content(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("node_id") == node_id).select("diagram_id", "content")


def find_nodes(nodes: DataFrame, keyword: str) -> DataFrame:
    """Nodes whose label has the word, case-insensitively."""
    return nodes.filter(F.lower("content").contains(keyword.lower()))


def node_tags(nodes: DataFrame) -> DataFrame:
    return with_keyword_tags(nodes, "content").select("diagram_id", "node_id", "tags")


def diagram_items(diagrams: DataFrame) -> DataFrame:
    """(diagram_id, part, key, pos, value, members): everything a diagram consists of, in one pass.

    ``part`` is type, metadata, subgraph, node or edge. Repeats of a key are
    merged as a whole: first position, last value, all live memberships.
    """
    line = F.col("line")

    def item(part: str, key: Column, type_: Column, content: Column, extra: Column | None = None) -> Column:
        return F.struct(
            F.lit(part).alias("part"), key.alias("key"), type_.alias("type"), content.alias("content"),
            (F.lit(None).cast("string") if extra is None else extra).alias("subgraph"),
        )

    none = F.lit(None).cast("string")
    found = F.col("found")
    per_line = F.array_compact(F.array(
        F.when(F.col("kind") == "type", item("type", F.lit(""), none, line)),
        F.when(
            (F.col("kind") == "metadata") & line.rlike(METADATA_PATTERN),
            item("metadata", F.regexp_extract(line, METADATA_PATTERN, 1), none, F.regexp_extract(line, METADATA_PATTERN, 2)),
        ),
        F.when(
            (F.col("kind") == "subgraph") & (F.col("scope_pos") == F.col("n")), item("subgraph", F.col("scope"), none, none)
        ),
        F.when(found.isNotNull(), item("node", found["node_id"], _shape(), found["content"], F.col("scope"))),
        F.when(
            _may_hold_edge() & line.rlike(EDGE_PATTERN),
            item("edge", F.col("n").cast("string"), F.regexp_extract(line, EDGE_PATTERN, 1), F.regexp_extract(line, EDGE_PATTERN, 2)),
        ),
    ))
    return (
        all_lines(diagrams)
        .withColumn("found", F.when(_may_hold_node(), _first_node()))
        .select("diagram_id", "n", "scope", "scope_pos", "live", F.explode(per_line).alias("i"))
        .groupBy("diagram_id", F.col("i.part").alias("part"), F.col("i.key").alias("key"))
        .agg(
            F.min("n").alias("pos"),
            F.max_by(F.struct("i.type", "i.content", "i.subgraph"), "n").alias("value"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        (F.col("i.part") == "node") & F.col("live"),
                        F.struct(F.col("n").alias("at"), F.col("scope").alias("subgraph"), F.col("scope_pos").alias("scope_pos")),
                    )
                )
            ).alias("members"),
        )
    )


def _node_line(node: Column, kind: Column, content: Column) -> Column:
    return (
        F.when(kind == "cylinder", F.concat(node, F.lit('[("'), content, F.lit('")]')))
        .when(kind == "rounded", F.concat(node, F.lit("("), content, F.lit(")")))
        .otherwise(F.concat(node, F.lit('["'), content, F.lit('"]')))
    )


def rebuild(diagrams: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Write diagrams again in canonical order, with new labels laid over the old.

    ``updates`` is (diagram_id, node_id, content). The order is type, metadata,
    subgraphs with their members, free nodes, edges.
    """
    items = diagram_items(diagrams)
    content = F.col("value.content")
    if updates is not None:
        new = updates.select("diagram_id", F.lit("node").alias("part"), F.col("node_id").alias("key"), F.col("content").alias("new_content"))
        items = items.join(new, ["diagram_id", "part", "key"], "left")
        content = F.coalesce("new_content", "value.content")
    key, pos, part = F.col("key"), F.col("pos"), F.col("part")
    far = F.lit(2**31 - 2)
    node = _node_line(key, F.col("value.type"), content)

    def row(section: int, a: Column, b: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), a.alias("a"), b.alias("b"), text.alias("text"))

    zero = F.lit(0)
    known = content.startswith("flowchart") | content.startswith("graph")
    rows = (
        F.when(part == "type", F.array(row(0, zero, zero, F.when(known, content).otherwise("")), row(0, zero, zero + 1, F.lit(""))))
        .when(part == "metadata", F.array(row(1, pos, zero, F.concat(F.lit("    "), key, F.lit("["), content, F.lit("]")))))
        .when(
            part == "subgraph",
            F.array(
                row(2, pos, zero, F.concat(F.lit("    subgraph "), key)), row(2, pos, far, F.lit("    end")),
                row(2, pos, far + 1, F.lit("")),
            ),
        )
        .when((part == "node") & (F.size("members") == 0), F.array(row(3, pos, zero, F.concat(F.lit("    "), node))))
        .when(
            part == "node",
            F.transform("members", lambda m: row(2, m["scope_pos"], m["at"], F.concat(F.lit("        "), node))),
        )
        .otherwise(
            F.array(row(4, pos, zero, F.concat(F.lit("    "), F.col("value.type"), F.lit(" --> "), content)))
        )
    )

    def section(k: int, gap: bool = False) -> Column:
        own = F.transform(F.filter("rows", lambda r: r["section"] == k), lambda r: r["text"])
        return F.concat(own, F.when(F.size(own) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))) if gap else own

    return (
        items.select("diagram_id", F.explode(rows).alias("r"))
        .groupBy("diagram_id")
        .agg(F.array_sort(F.collect_list("r")).alias("rows"))
        .select(
            "diagram_id",
            F.array_join(F.concat(section(0), section(1, True), section(2), section(3, True), section(4)), "\n").alias("code"),
        )
    )


def validate(diagrams: DataFrame) -> DataFrame:
    """(diagram_id, valid, reason): the first failing check, read within the row."""
    rows = F.transform(F.split(strip(F.col("code")), "\n"), strip)
    checked = diagrams.select("diagram_id", "code", F.when(~is_blank(F.col("code")), rows).alias("rows")).select(
        "diagram_id",
        "code",
        F.col("rows")[0].alias("head"),
        F.size(F.filter("rows", lambda x: x.startswith("subgraph"))).alias("opens"),
        F.size(F.filter("rows", lambda x: x == "end")).alias("ends"),
        F.exists(F.slice("rows", 2, F.size("rows")), lambda x: x.contains("[") | x.contains("(")).alias("has_node"),
    )
    head = F.col("head")
    reason = (
        F.when(head.isNull(), "Empty diagram code")
        .when(~(head.startswith("flowchart") | head.startswith("graph")), "Missing or invalid diagram type declaration")
        .when(
            F.col("opens") != F.col("ends"),
            F.concat(
                F.lit("Unbalanced subgraphs: "), F.col("opens").cast("string"), F.lit(" subgraph(s) vs "),
                F.col("ends").cast("string"), F.lit(" end(s)"),
            ),
        )
        .when(~F.col("has_node"), "No nodes found in diagram")
        .otherwise("Valid")
    )
    return checked.select("diagram_id", (reason == "Valid").alias("valid"), reason.alias("reason"))


def diagram_struct(diagrams: DataFrame) -> DataFrame:
    """A diagram as one nested row: type, nodes, edges, subgraphs and metadata."""
    head = F.col("value.content")
    known = head.startswith("flowchart") | head.startswith("graph")

    def every(part: str, *columns: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("pos", *columns)))).alias(part)

    key = F.col("key")
    whole = (
        diagram_items(diagrams)
        .groupBy("diagram_id")
        .agg(
            F.max(F.when(F.col("part") == "type", F.when(known, head).otherwise(""))).alias("diagram_type"),
            every(
                "node", key.alias("node_id"), F.col("value.type").alias("type"), F.col("value.content").alias("content"),
                F.col("value.subgraph").alias("subgraph"), F.col("members"),
            ),
            every("edge", F.col("value.type").alias("src"), F.col("value.content").alias("dst")),
            every("subgraph", key.alias("name")),
            every("metadata", key.alias("key"), F.col("value.content").alias("value")),
        )
    )
    placed = F.array_sort(
        F.flatten(
            F.transform(
                "node",
                lambda n: F.transform(
                    n["members"],
                    lambda m: F.struct(m["scope_pos"].alias("scope_pos"), m["at"].alias("at"), n["node_id"].alias("node_id")),
                ),
            )
        )
    )
    return whole.withColumn("placed", placed).select(
        "diagram_id",
        "diagram_type",
        F.transform(
            "node", lambda n: F.struct(n["node_id"].alias("node_id"), n["type"].alias("type"), n["content"].alias("content"), n["subgraph"].alias("subgraph"))
        ).alias("nodes"),
        F.transform("edge", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"))).alias("edges"),
        F.transform(
            "subgraph",
            lambda s: F.struct(
                s["name"].alias("subgraph"),
                F.transform(F.filter("placed", lambda m: m["scope_pos"] == s["pos"]), lambda m: m["node_id"]).alias("ids"),
            ),
        ).alias("subgraphs"),
        F.map_from_entries(F.transform("metadata", lambda m: F.struct(m["key"], m["value"]))).alias("metadata"),
    )


def node_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its neighbours in edge order and its tags."""
    ends = F.inline(F.array(
        F.struct(F.col("dst").alias("node_id"), F.lit(True).alias("into"), F.col("src").alias("other")),
        F.struct(F.col("src").alias("node_id"), F.lit(False).alias("into"), F.col("dst").alias("other")),
    ))

    def side(into: bool, name: str) -> Column:
        own = F.collect_list(F.when(F.col("into") == into, F.struct("seq", "other")))
        return F.transform(F.array_sort(own), lambda e: e["other"]).alias(name)

    around = (
        edges.select("diagram_id", "seq", ends)
        .groupBy("diagram_id", "node_id")
        .agg(side(True, "incoming"), side(False, "outgoing"))
    )
    none = F.array().cast("array<string>")
    return with_keyword_tags(nodes, "content").join(around, ["diagram_id", "node_id"], "left").select(
        "diagram_id", "node_id", "content", "type", "subgraph",
        F.coalesce("incoming", none).alias("incoming"),
        F.coalesce("outgoing", none).alias("outgoing"),
        "tags",
    )


def edge_ends(edges: DataFrame) -> DataFrame:
    return edges.select("diagram_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge touches."""
    return nodes.join(edge_ends(edges), ["diagram_id", "node_id"], "left_anti").select("diagram_id", "node_id")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that are not nodes."""
    return edge_ends(edges).join(nodes, ["diagram_id", "node_id"], "left_anti").select("diagram_id", "node_id")


def bullet_lint(nodes: DataFrame, limit: int = 3) -> DataFrame:
    """Nodes with more than ``limit`` label lines."""
    bullets = F.size(F.split("content", "<br/>")).cast("long")
    return nodes.select("diagram_id", "node_id", bullets.alias("bullets")).filter(F.col("bullets") > limit)


def locked_diff(
    before_nodes: DataFrame, after_nodes: DataFrame,
    before_edges: DataFrame, after_edges: DataFrame, affected: DataFrame,
) -> DataFrame:
    """(diagram_id, item, what): every way an update left the locked structure.

    Nodes are added, removed, moved to another subgraph, or changed though not
    affected; edges are compared as a multi-set.
    """
    keys = ["diagram_id", "node_id"]
    old = before_nodes.select(*keys, F.col("content").alias("old"), F.col("subgraph").alias("old_sub"), F.lit(1).alias("was"))
    new = after_nodes.select(*keys, F.col("content").alias("new"), F.col("subgraph").alias("new_sub"), F.lit(1).alias("is"))
    allowed = affected.select(*keys).distinct().withColumn("allowed", F.lit(True))
    both = old.join(new, keys, "full_outer").join(allowed, keys, "left")
    what = (
        F.when(F.col("was").isNull(), "node added")
        .when(F.col("is").isNull(), "node removed")
        .when(~F.col("old_sub").eqNullSafe(F.col("new_sub")), "node moved")
        .when(~F.col("old").eqNullSafe(F.col("new")) & F.col("allowed").isNull(), "unexpected change")
        .when(~F.col("old").eqNullSafe(F.col("new")), "expected change")
    )
    node_rows = both.select("diagram_id", F.col("node_id").alias("item"), what.alias("what"))
    signed = before_edges.select("diagram_id", "src", "dst", F.lit(-1).alias("d")).unionByName(
        after_edges.select("diagram_id", "src", "dst", F.lit(1).alias("d"))
    )
    edge_rows = (
        signed.groupBy("diagram_id", "src", "dst")
        .agg(F.sum("d").alias("d"))
        .select(
            "diagram_id",
            F.concat("src", F.lit(" --> "), "dst").alias("item"),
            F.when(F.col("d") > 0, "edge added").when(F.col("d") < 0, "edge removed").alias("what"),
        )
    )
    return node_rows.unionByName(edge_rows).filter(F.col("what").isNotNull())
