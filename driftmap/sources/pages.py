"""Diagram pages: reading the diagram out of HTML and writing valid ones back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.functions.text import strip
from driftmap.operators.diagram import validate

DIAGRAM_BLOCK = r'(?s)<div class="mermaid">\s*(.*?)\s*</div>'

# The page a diagram is shown in.
PAGE_HEAD = """<!DOCTYPE html>
<html>
<head>
    <meta charset="UTF-8">
    <title>Mermaid Diagram</title>
</head>
<body>
    <div class="mermaid">
"""
PAGE_TAIL = """
    </div>
    <script type="module">
        import mermaid from 'https://cdn.jsdelivr.net/npm/mermaid@10/dist/mermaid.esm.min.mjs';
        mermaid.initialize({ startOnLoad: true });
    </script>
</body>
</html>
"""


def page_of(code: Column) -> Column:
    return F.concat(F.lit(PAGE_HEAD), code, F.lit(PAGE_TAIL))


def extract_diagrams(pages: DataFrame) -> DataFrame:
    """(diagram_id, code): the first diagram block of each page, null where there is none."""
    html = F.col("html")
    code = F.when(html.contains('<div class="mermaid">') & html.rlike(DIAGRAM_BLOCK), strip(F.regexp_extract(html, DIAGRAM_BLOCK, 1)))
    return pages.select("diagram_id", code.alias("code"))


def valid_pages(diagrams: DataFrame) -> DataFrame:
    """(diagram_id, html) of the diagrams that pass validation."""
    good = validate(diagrams).filter("valid").select("diagram_id")
    return diagrams.join(good, "diagram_id", "left_semi").select("diagram_id", page_of(F.col("code")).alias("html"))


def write_pages(diagrams: DataFrame, path: str) -> None:
    """Write the pages of valid diagrams as a table keyed by diagram."""
    valid_pages(diagrams).write.mode("overwrite").parquet(path)


def export_page_files(diagrams: DataFrame, path: str) -> None:
    """One folder with one HTML file per diagram, for viewers that need files."""
    valid_pages(diagrams).write.mode("overwrite").option("lineSep", "\n").partitionBy("diagram_id").text(path)
