"""Column functions on text. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

FENCE = "```"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks as ``trim`` does."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def truncate(c: Column, limit: int, suffix: str = "") -> Column:
    """The first ``limit`` characters, with ``suffix`` only where text was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(suffix))).otherwise(c)


def start_of(c: Column, limit: int | None, suffix: str = "") -> Column:
    """A text as it is, or its first ``limit`` characters if a limit is given."""
    return c if limit is None else truncate(c, limit, suffix)


def clean_diagram_reply(c: Column) -> Column:
    """Drop code fences and every non-ASCII character."""
    no_fence = F.replace(F.replace(c, F.lit(FENCE + "mermaid"), F.lit("")), F.lit(FENCE), F.lit(""))
    return F.regexp_replace(no_fence, r"[^\x00-\x7F]", "")


def unfence_json(c: Column) -> Column:
    """The body of a reply that may be wrapped in a fenced block."""
    body = strip(c)
    inner = F.split(body, FENCE)[1]
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 2**31 - 1)).otherwise(inner)
    return F.when(body.startswith(FENCE), strip(inner)).otherwise(body)


def passes_quality(c: Column, min_chars: int = 10, min_distinct: int = 2) -> Column:
    """More than ``min_chars`` characters, of which more than ``min_distinct`` differ."""
    return (F.length(c) > min_chars) & (F.size(F.array_distinct(F.split(c, ""))) > min_distinct)


def computed(items: Column | str) -> Column:
    """An array column that was computed earlier, ready to explode.

    Exploding the bare column lets Spark test its size first, in a filter that
    it pushes below the projection: the array would be computed twice.
    """
    return F.array_compact(items)


def count_numbered_steps(c: Column) -> Column:
    """Lines that start a numbered list item."""
    return F.regexp_count(c, F.lit(r"(?dm)^\s*\d+\.\s+"))


def count_bracket_nodes(c: Column) -> Column:
    """Heuristic: identifiers followed by a bracket pair. Over-counts mark-up inside labels."""
    # from the start of a word and without going back: a word before no bracket is read once, not once from each of its signs
    return F.regexp_count(c, F.lit(r"(?dU)(?<!\w)\w++\s*+[\[\(\{\<][^\]\)\}\>\n]*+[\]\)\}\>]"))


# Fixed values: (pattern, replacement) in the order they are applied.
HTML_RULES = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<head\b[^>]*>.*?</head>", ""),
    (r"(?is)<script\b[^>]*>.*?</script>", ""),
    (r"(?is)<style\b[^>]*>.*?</style>", ""),
    (r"(?i)<img\b[^>]*>", ""),
    (r"(?i)<h1\b[^>]*>", "\n\n# "),
    (r"(?i)<h2\b[^>]*>", "\n\n## "),
    (r"(?i)<h3\b[^>]*>", "\n\n### "),
    (r"(?i)</h[1-6]>", "\n\n"),
    (r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<li\b[^>]*>", "\n* "),
    (r"(?i)</?(b|strong)>", "**"),
    (r"(?i)</?(i|em)>", "*"),
    (r"(?i)</?(p|div|article|section|ul|ol|table|tr)\b[^>]*>", "\n\n"),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
]


def html_to_text(c: Column, underlined: bool = False) -> Column:
    """Mark-up to text by a listed rule chain; no general converter.

    Articles lose their underscores and mark headings by ``#``. Sources with
    ``underlined`` first headings keep underscores; their lines of ``=`` go, and all
    other ``=`` with them, so such a heading is a plain line.
    """
    out = strip(c if underlined else F.replace(c, F.lit("_"), F.lit("")))
    for pattern, replacement in HTML_RULES:
        out = F.regexp_replace(out, pattern, "\n\n" if underlined and "h1" in pattern else replacement)
    if underlined:
        out = F.replace(out, F.lit("="), F.lit(""))
    return strip(out)
