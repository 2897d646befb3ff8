"""Update requests: what is sent out for a diagram that needs new labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.functions.text import start_of

METADATA_HEADER = "PIPELINE METADATA (Use this context to enhance the diagram):"

# Optional fields and the label each is shown with, in order.
METADATA_FIELDS = [
    ("name", "Pipeline Name"), ("purpose", "Purpose"), ("data_type", "Data Type"),
    ("data_source", "Data Source"), ("use_case", "Use Case"), ("owner", "Owner"),
]


def metadata_block(fields: dict[str, Column]) -> Column:
    """Header and one line per field that is set; '' where none is."""
    shown = [
        F.when(fields[name] != "", F.concat(F.lit(f"    - {label}: "), fields[name]))
        for name, label in METADATA_FIELDS
        if name in fields
    ]
    body = F.concat_ws("\n", *shown)
    return F.when(body != "", F.concat(F.lit(f"\n    {METADATA_HEADER}\n"), body, F.lit("\n"))).otherwise("")


def build_requests(
    runs: DataFrame, affected: DataFrame, context: DataFrame, diagrams: DataFrame,
    diff_chars: int | None = None, node_chars: int | None = None,
) -> DataFrame:
    """One request row per run: locked diagram, affected ids, node details, diff or its start.

    ``runs`` is (change_id, diagram_id, diff_text, metadata). Details come
    from the affected nodes of one diagram, so the group is bounded by it.
    """
    detail = F.concat(
        F.lit("\n  Node "), "node_id", F.lit(":"),
        F.lit("\n    - Current Content: "), start_of(F.col("content"), node_chars, "..."),
        F.lit("\n    - Subgraph: "), F.coalesce("subgraph", F.lit("None")),
        F.lit("\n    - Keywords: "), F.array_join("tags", ", "),
        F.lit("\n    - Connected to: "), F.array_join(F.concat("incoming", "outgoing"), ", "),
    )
    told = context.select("diagram_id", "node_id", detail.alias("detail"))
    per_run = (
        affected.join(told, ["diagram_id", "node_id"])
        .groupBy("change_id", "diagram_id")
        .agg(F.array_sort(F.collect_list(F.struct("node_id", "detail"))).alias("nodes"))
        .select(
            "change_id", "diagram_id",
            F.array_join(F.transform("nodes", lambda n: n["node_id"]), ", ").alias("affected_nodes"),
            F.array_join(F.transform("nodes", lambda n: n["detail"]), "").alias("node_details"),
        )
    )
    return (
        runs.join(per_run, ["change_id", "diagram_id"], "left")
        .join(diagrams.select("diagram_id", F.col("code").alias("existing_diagram")), "diagram_id")
        .select(
            "change_id", "diagram_id", "metadata", "existing_diagram",
            F.coalesce("affected_nodes", F.lit("None detected")).alias("affected_nodes"),
            F.coalesce("node_details", F.lit("")).alias("node_details"),
            start_of(F.col("diff_text"), diff_chars).alias("diff_start"),
        )
    )
