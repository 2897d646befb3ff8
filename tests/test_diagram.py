"""Parsing traps on diagrams made for them, with counts worked out by hand."""

import pytest

from driftmap.operators import diagram as D
from driftmap.operators.reports import heuristic_nodes
from driftmap.sources import pages as P

# Five nodes in two subgraphs and one outside, three shapes, four edges; the purpose line is metadata.
SHOP = """
flowchart LR
    purpose[Orders of a shop]

    subgraph Intake
        W["Webhook<br/> bucket of raw orders"]
        Q[(Queue)]
    end

    V("Validate rows")

    subgraph Ledger
        L["Ledger table"]
        R[(Refund archive)]
    end

    W --> Q
    Q --> V
    V --> L
    V --> R
"""

# A title that is a node without edges, two metadata lines, an edge from a subgraph's name.
PRESS = """
flowchart TD
    subgraph Facts
        title["Name: press archive"]
        purpose["Purpose: index scanned papers"]
        note["Owner: reading room"]
    end

    subgraph Scans
        S["Scans in a GCS bucket"]
        O["Text recognition<br/> Language: auto"]
    end

    subgraph Pieces
        P["Chunking by paragraph<br/> chunk_size from settings"]
    end

    subgraph Vectors
        M["Embedding model: large"]
        K[(Pickle cache)]
    end

    Facts --> S
    S --> O
    O --> P
    P --> M
    M --> K
"""

# Ends that are no nodes on both sides: metadata on the right, a name never defined on the left.
LOOSE = """
flowchart TD
    purpose[Nightly copy]
    A["Read"]
    B["Write"]
    A --> B
    A --> purpose
    ghost --> B
"""


def diagrams(spark, **codes):
    return spark.createDataFrame(list(codes.items()), "diagram_id string, code string")


def parse(spark, code):
    d = diagrams(spark, x=code)
    lines = D.diagram_lines(d)
    return d, lines, D.diagram_nodes(D.node_definitions(lines)), D.diagram_edges(lines)


@pytest.mark.parametrize(
    "code, nodes, edges, subgraphs, heuristic",
    [(SHOP, 5, 4, 2, 6), (PRESS, 6, 5, 4, 8), (LOOSE, 2, 3, 0, 3)],
)
def test_counts(spark, code, nodes, edges, subgraphs, heuristic):
    d, lines, n, e = parse(spark, code)
    assert (n.count(), e.count(), D.subgraphs(lines).count()) == (nodes, edges, subgraphs)
    assert heuristic_nodes(d).first()["diagram_steps"] == heuristic


def test_orphan_and_dangling_end(spark, rows):
    _, lines, n, e = parse(spark, PRESS)
    assert rows(D.orphans(n, e)) == [("x", "title")]
    assert rows(D.dangling(n, e)) == [("x", "Facts")]
    assert D.diagram_metadata(lines).count() == 2  # purpose and note, quotes kept
    assert D.diagram_metadata(lines).filter("key = 'note'").first()["value"] == '"Owner: reading room"'


def test_metadata_and_unknown_names_dangle(spark, rows):
    _, _, n, e = parse(spark, LOOSE)
    assert rows(D.dangling(n, e)) == [("x", "ghost"), ("x", "purpose")]


def test_tags(spark):
    _, _, n, _ = parse(spark, PRESS)
    assert {r["node_id"]: set(r["tags"]) for r in D.node_tags(n).collect()} == {
        "title": set(), "S": {"bucket", "gcs", "storage"}, "O": set(), "P": {"chunk", "chunk_size", "chunking"},
        "M": {"embed", "embedding", "model"}, "K": {"cache", "pickle"},
    }


def test_first_line_is_never_content(spark):
    _, lines, n, _ = parse(spark, 'A["x"]\nB["y"]')
    assert [r["node_id"] for r in n.collect()] == ["B"]


def test_scope_is_one_variable_not_a_stack(spark):
    code = 'graph TD\nsubgraph Out\nA["a"]\nsubgraph In\nB["b"]\nend\nC["c"]\nend\nsubgraph -bad\nD["d"]'
    _, _, n, _ = parse(spark, code)
    assert {r["node_id"]: r["subgraph"] for r in n.collect()} == {"A": "Out", "B": "In", "C": None, "D": None}


def test_bad_subgraph_name_keeps_scope(spark):
    _, _, n, _ = parse(spark, 'graph TD\nsubgraph S\nsubgraph "quoted name"\nA["a"]\nend')
    assert n.first()["subgraph"] == "S"


def test_redefined_node_keeps_first_place_and_old_membership(spark, rows):
    _, lines, n, _ = parse(spark, 'graph TD\nsubgraph S\nA["one"]\nend\nB["b"]\nA["two"]')
    a = n.filter("node_id = 'A'").first()
    assert (a["content"], a["pos"], a["subgraph"]) == ("two", 2, None)
    assert rows(D.subgraph_members(lines).select("subgraph", "node_id")) == [("S", "A")]


def test_reopened_subgraph_loses_earlier_members(spark, rows):
    _, lines, _, _ = parse(spark, 'graph TD\nsubgraph S\nA["a"]\nend\nsubgraph T\nX["x"]\nend\nsubgraph S\nB["b"]\nend')
    assert rows(D.subgraph_members(lines).select("subgraph", "node_id")) == [("S", "B"), ("T", "X")]
    assert rows(D.subgraphs(lines).select("subgraph", "pos")) == [("S", 1), ("T", 4)]


def test_shapes_and_first_match(spark):
    code = "\n".join([
        "graph TD", 'A["a(b)"]', 'B[("b")]', "C[(c)]", "D[d]", "E(e)", 'F["f"] --> G["g"]', "H -->|x| I", "J -.-> K", "L --- M",
    ])
    _, _, n, e = parse(spark, code)
    got = {r["node_id"]: (r["type"], r["content"]) for r in n.collect()}
    assert got == {
        "A": ("rect", "a(b)"), "B": ("cylinder", "b"), "C": ("cylinder", "c"), "D": ("rect", "d"),
        "E": ("rounded", "e"), "F": ("rect", "f"),
    }
    # The first edge match on F's line starts at F itself.
    assert sorted((r["src"], r["dst"]) for r in e.collect()) == [("F", "G"), ("L", "M")]


def test_metadata_needs_square_bracket(spark, rows):
    _, lines, n, _ = parse(spark, 'graph TD\ntitle(X)\npurpose["p"]\nnote[n]\nnote[m]\ntitle["t"]')
    assert rows(D.diagram_metadata(lines).select("key", "value")) == [("note", "m"), ("purpose", '"p"')]
    assert [r["node_id"] for r in n.collect()] == ["title"]


def test_validation_reasons(spark):
    d = diagrams(
        spark, empty="  \n", kind="A[x]", unbalanced="graph TD\nsubgraph S\nA[x]", nodeless="flowchart TD\nA --> B",
        good="graph TD\nA[x]",
    )
    got = {r["diagram_id"]: (r["valid"], r["reason"]) for r in D.validate(d).collect()}
    assert got == {
        "empty": (False, "Empty diagram code"),
        "kind": (False, "Missing or invalid diagram type declaration"),
        "unbalanced": (False, "Unbalanced subgraphs: 1 subgraph(s) vs 0 end(s)"),
        "nodeless": (False, "No nodes found in diagram"),
        "good": (True, "Valid"),
    }


@pytest.mark.parametrize("code", [SHOP, PRESS])
def test_rebuild_keeps_structure(spark, rows, code):
    d, lines, n, e = parse(spark, code)
    again = D.rebuild(d)
    lines2 = D.diagram_lines(again)
    n2 = D.diagram_nodes(D.node_definitions(lines2))
    cols = ["node_id", "type", "content", "subgraph"]
    assert rows(n.select(*cols)) == rows(n2.select(*cols))
    assert [tuple(r) for r in e.orderBy("seq").select("src", "dst").collect()] == [
        tuple(r) for r in D.diagram_edges(lines2).orderBy("seq").select("src", "dst").collect()
    ]
    changed = D.locked_diff(n, n2, e, D.diagram_edges(lines2), n.limit(0))
    assert changed.count() == 0


def test_rebuild_text_with_update(spark):
    d = diagrams(spark, x='graph TD\n note[n]\nsubgraph S\nA["a"]\nA["b"]\nend\nC[(c)]\nA --> C')
    new = spark.createDataFrame([("x", "A", "new")], "diagram_id string, node_id string, content string")
    assert D.rebuild(d, new).first()["code"] == "\n".join([
        "graph TD", "", "    note[n]", "", "    subgraph S", '        A["new"]', '        A["new"]', "    end", "",
        '    C[("c")]', "", "    A --> C",
    ])


def test_page_round_trip(spark):
    d = diagrams(spark, a=SHOP.strip(), b="graph TD")
    pages = P.valid_pages(d)
    assert [r["diagram_id"] for r in pages.collect()] == ["a"]
    assert P.extract_diagrams(pages).first()["code"] == SHOP.strip()
    none = spark.createDataFrame([("z", "<div>no</div>")], "diagram_id string, html string")
    assert P.extract_diagrams(none).first()["code"] is None


def test_nested_form(spark):
    r = D.diagram_struct(diagrams(spark, x=PRESS)).first()
    assert r["diagram_type"] == "flowchart TD"
    assert [n["node_id"] for n in r["nodes"]] == ["title", "S", "O", "P", "M", "K"]
    assert [(s["subgraph"], s["ids"]) for s in r["subgraphs"]][:2] == [("Facts", ["title"]), ("Scans", ["S", "O"])]
    assert set(r["metadata"]) == {"purpose", "note"}


def test_bullet_lint(spark, rows):
    _, _, n, _ = parse(spark, 'graph TD\nA["1<br/>2<br/>3<br/>4"]\nB["1<br/>2<br/>3"]')
    assert rows(D.bullet_lint(n)) == [("x", "A", 4)]


def test_parsing_a_diagram_needs_no_shuffle(spark):
    d = diagrams(spark, x=SHOP)
    plan = D.node_definitions(D.diagram_lines(d))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_keyword_search(spark, rows):
    _, _, n, _ = parse(spark, SHOP)
    assert rows(D.find_nodes(n, "ARCHIVE").select("node_id")) == [("R",)]
    assert rows(D.find_nodes(n, "row").select("node_id")) == [("V",)]
