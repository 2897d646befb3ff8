"""Source files to comment, statement and setting rows.

One Python stage reads syntax trees and emits flat rows; classing, cutting,
comment attachment and rendering are ordinary Spark steps on those rows.
"""

from __future__ import annotations

import ast
import gc
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.keywords import has_config_word, is_log_call
from driftmap.functions.text import start_of, strip

PARSED_SCHEMA = (
    "repo_id string, path string, seq int, line int, indent int, node string, target string, "
    "callee string, args array<string>, kwargs array<string>, value_kind string, value string"
)
_ARROW = pa.schema(
    [("repo_id", pa.string()), ("path", pa.string()), ("seq", pa.int32()), ("line", pa.int32()),
     ("indent", pa.int32()), ("node", pa.string()), ("target", pa.string()), ("callee", pa.string()),
     ("args", pa.list_(pa.string())), ("kwargs", pa.list_(pa.string())), ("value_kind", pa.string()),
     ("value", pa.string())]
)
_BATCH_ROWS = 10_000
_KEEP_COMMENT = 100

#: Signs of comparisons, as the unparser writes them.
_SIGNS = {
    ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=",
    ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in",
}
#: Fields that never hold a node to visit: names, contexts and operators.
_BARE = {"ctx", "op", "ops", "id", "attr", "arg", "asname", "module", "level", "kind", "type_comment", "type_ignores", "conversion", "is_async", "simple"}


#: Kinds of nodes, which are asked for at every node.
_NAME, _CONSTANT, _ATTRIBUTE, _COMPARE = ast.Name, ast.Constant, ast.Attribute, ast.Compare
_CALL, _DICT, _EXPR, _ASSIGN, _IF, _DEF = ast.Call, ast.Dict, ast.Expr, ast.Assign, ast.If, ast.FunctionDef
_PLAIN = (str, int, type(None))


def _leaf(node: ast.expr) -> str | None:
    """Source text of a name, a plain constant or a dotted name, and nothing for all else."""
    kind = type(node)
    if kind is _NAME:
        return node.id
    if kind is _CONSTANT:
        value = node.value
        return repr(value) if isinstance(value, _PLAIN) and node.kind is None else None
    if kind is _ATTRIBUTE:
        base = node.value
        if type(base) is _NAME:
            return f"{base.id}.{node.attr}"
        if type(base) is _ATTRIBUTE:
            told = _leaf(base)
            return None if told is None else f"{told}.{node.attr}"
    return None


def _source(node: ast.expr) -> str:
    """Source text of an expression; the common leaves, and comparisons of them, need no unparser."""
    if type(node) is _NAME:
        return node.id
    told = _leaf(node)
    if told is None and type(node) is _COMPARE:
        sides = [_leaf(n) for n in (node.left, *node.comparators)]
        if None not in sides:
            told = sides[0] + "".join([f" {_SIGNS[type(op)]} {side}" for op, side in zip(node.ops, sides[1:])])
    return ast.unparse(node) if told is None else told


def _call_parts(call: ast.Call) -> tuple[str, list[str], list[str]]:
    args, kwargs = call.args, call.keywords
    return _source(call.func), args and [_source(a) for a in args], kwargs and [f"{k.arg}={_source(k.value)}" for k in kwargs]


class _Fields(dict):
    """Fields of each kind of node that may hold nodes to visit, found once."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = tuple(f for f in kind._fields if f not in _BARE)
        return self[kind]


_FIELDS = _Fields()
#: What has nothing below it to look for, nodes or not.
_ENDS = {ast.Name, ast.Constant, ast.Import, ast.ImportFrom, *_PLAIN}


def _statements(tree: ast.AST, indent: int, found: list[tuple]) -> None:
    """Branches, definitions, assignments and calls in visiting order, as the columns from ``seq`` on.

    Nothing below an assignment, a call or an import is looked at.
    """
    for field in _FIELDS[type(tree)]:
        part = getattr(tree, field, None)
        if not part:
            continue
        for child in part if type(part) is list else (part,):
            kind = type(child)
            if kind is _EXPR:
                child = child.value
                kind = type(child)
            if kind is _CALL:
                callee, args, kwargs = _call_parts(child)
                first = child.args[0] if args else None
                told = str(first.value) if type(first) is _CONSTANT else None
                found.append((len(found), child.lineno, indent, "call", None, callee, args, kwargs, None, told))
            elif kind is _ASSIGN:
                targets, value = child.targets, child.value
                target = _source(targets[0]) if len(targets) == 1 else "=".join([_source(t) for t in targets])
                kind = type(value)
                callee = args = kwargs = told = None
                if kind is _CALL:
                    callee, args, kwargs = _call_parts(value)
                    value_kind = "call"
                elif kind is _DICT:
                    args, value_kind = [_source(k) for k in value.keys if k], "dict"
                elif kind is _CONSTANT and isinstance(value.value, str):
                    value_kind, told = "str", value.value
                else:
                    value_kind = "other"
                found.append((len(found), child.lineno, indent, "assign", target, callee, args, kwargs, value_kind, told))
            elif kind in _ENDS:
                continue
            elif kind is _IF:
                found.append((len(found), child.lineno, indent, "if", None, None, None, None, None, _source(child.test)))
                _statements(child, indent + 1, found)
            elif kind is _DEF:
                found.append((len(found), child.lineno, indent, "def", child.name, None, None, None, None, None))
                _statements(child, indent + 1, found)
            elif isinstance(child, ast.AST):
                _statements(child, indent, found)


def _told_by(source: str) -> list[tuple]:
    """Statements of a source.

    A tree is many objects without a cycle, gone before the next one is built: the collector, which
    would start by their number and pass through them in vain, waits for that long.
    """
    found: list[tuple] = []
    collects = gc.isenabled()
    gc.disable()
    try:
        _statements(ast.parse(source), 0, found)
    finally:
        if collects:
            gc.enable()
    return found


def _comments(source: str) -> Iterator[tuple[int, str]]:
    """(line, text) of each comment."""
    if "#" not in source:
        return
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type == tokenize.COMMENT:
                yield token.start[0], token.string
    except (tokenize.TokenError, SyntaxError):
        return  # what was read before the fault still counts


#: Strings and comments of a source without fault, and where quotes alone don't tell strings: formatted ones, odd line ends.
#: Each choice begins with one sign, and what precedes a quote is looked at behind it, so both skip fast to the next such sign.
_QUOTED = re.compile(
    r"""(?s)#[^\n]*+|""{2}(?:[^"\\]++|\\.|"(?!""))*+"{3}|''{2}(?:[^'\\]++|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'"""
)
_UNSURE = re.compile(r"""["'\r\f](?:(?<=[\r\f])|(?<=[fFtT].)|(?<=[fFtT][rR].))""")


def _plain_comments(source: str) -> Iterator[tuple[int, str]]:
    """The same for a source that was parsed and holds nothing ``_UNSURE``, in a tenth of the time."""
    line, at = 1, 0
    for found in _QUOTED.finditer(source):
        start = found.start()
        if source[start] == "#":
            line, at = line + source.count("\n", at, start), start
            yield line, found[0]


def _file_rows(source: str | None) -> list[tuple]:
    """Rows of a file: what ``PARSED_SCHEMA`` has behind the file's key."""
    rows = [_row("file")]
    if source is None:
        return [*rows, _row("error", "unreadable text")]
    try:
        found = _told_by(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as fault:
        noted, found, error = _comments(source), [], [_row("error", str(fault))]
    else:
        noted, error = (_comments if _UNSURE.search(source) else _plain_comments)(source), []
    rows += [(None, line, None, "comment", None, None, None, None, None, text) for line, text in noted]
    return rows + error + found


def _row(node: str, value: str | None = None) -> tuple:
    """A row that is no statement, of the whole file."""
    return None, None, None, node, None, None, None, None, None, value


def _batch(repos: list, paths: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = [repos, paths, *zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repos, paths, rows = [], [], []
    for batch in batches:
        for repo_id, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "content"))):
            more = _file_rows(content)
            repos += [repo_id] * len(more)
            paths += [path] * len(more)
            rows += more
            if len(rows) >= _BATCH_ROWS:
                yield _batch(repos, paths, rows)
                repos, paths, rows = [], [], []
    if rows:
        yield _batch(repos, paths, rows)


def _by_file(rows: DataFrame) -> DataFrame:
    """The rows, dealt by file to as many tasks as a shuffle has, which are not merged by their few bytes."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "repo_id", "path")


def parse_files(files: DataFrame) -> DataFrame:
    """Syntax rows of each Python file: the file, its comments, its statements in visiting order, or its fault.

    ``files`` is (repo_id, path, content), already filtered: this is the only
    Python stage. Parsing costs far more than moving a file, so files are
    spread by path first: sizes differ, and one repository may hold a large
    part of all files. Their number of tasks is given, since Spark would
    otherwise merge tasks by bytes, of which sources have few for the time they take.
    """
    return _by_file(files.select("repo_id", "path", "content")).mapInArrow(_parse_batches, PARSED_SCHEMA)


def comment_start(text: Column) -> Column:
    """The first signs in capitals: all that a class asks of them; signs only get more by it."""
    return F.upper(F.substring(text, 1, 20))


def comment_class(text: Column, start: Column | None = None) -> Column:
    """First class that fits a comment text; ``start`` is its ``comment_start``, if that is a column already."""
    up = comment_start(text) if start is None else start
    todo = up.startswith("TODO") | up.startswith("FIXME") | up.startswith("HACK") | up.startswith("XXX")
    return (
        F.when(text.startswith("=") | text.startswith("-"), "section_header")
        .when(todo, "todo")
        .when(F.substring(up, 1, 20).contains("STEP"), "step_marker")
        .when(F.length(text) > _KEEP_COMMENT, "docstring")
        .otherwise("explanation")
    )


def comment_text(raw: Column) -> Column:
    return strip(F.btrim(raw, F.lit("#")))


def comments(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, text, type, raw) by a line scan, without Python.

    A ``#`` inside a one-line string is not a comment. Strings over several
    lines are the known gap; ``parsed_comments`` is exact.
    """
    # possessive: neither a long line nor an open quote makes the matcher go back
    pattern = r"""^(?:[^'"#]++|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+')*+(#.*)$"""
    found = (
        files.select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("i", "row"))
        .filter(F.col("row").contains("#"))
        .select("repo_id", "path", (F.col("i") + 1).alias("line"), F.regexp_extract("row", pattern, 1).alias("raw"))
    )
    return _with_comment_columns(found)


#: What a source file is made of, from left to right: comments, strings over lines, strings within one, all else, line ends.
_PIECES = (
    r"""(?s)#[^\n]*+|"{3}(?:[^"\\]++|\\.|"(?!""))*+(?:"{3}|\z)|'{3}(?:[^'\\]++|\\.|'(?!''))*+(?:'{3}|\z)"""
    r"""|"(?:[^"\\\n]++|\\.)*+"?|'(?:[^'\\\n]++|\\.)*+'?|[^#"'\n]++|\n"""
)


def scanned_comments(files: DataFrame) -> DataFrame:
    """The same table for strings over any number of lines, still without Python.

    The file is cut into its pieces inside its row; of all pieces that are no comments only
    the line ends stay, so what is left on a line is its comment. Quotes inside the braces of a
    formatted string count as quotes, as they did before Python 3.12.
    """
    pieces = F.regexp_extract_all("content", F.lit(_PIECES), F.lit(0))
    bare = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("#"), p).otherwise(F.regexp_replace(p, r"[^\n]++", ""))), "")
    found = (
        files.where(F.col("content").contains("#")).select("repo_id", "path", F.posexplode(F.split(bare, "\n")).alias("i", "raw"))
        .where("raw <> ''").select("repo_id", "path", (F.col("i") + 1).alias("line"), "raw")
    )
    return _with_comment_columns(found)


def parsed_comments(parsed: DataFrame) -> DataFrame:
    """The same table from the syntax rows."""
    return _with_comment_columns(
        parsed.filter(F.col("node") == "comment").select("repo_id", "path", "line", F.col("value").alias("raw"))
    )


def _with_comment_columns(found: DataFrame) -> DataFrame:
    return (
        found.withColumn("text", comment_text(F.col("raw")))
        .filter(F.col("text") != "")
        .select("repo_id", "path", "line", "text", comment_class(F.col("text")).alias("type"), "raw")
    )


def _arg_text() -> Column:
    return F.when(
        F.col("node") == "assign", F.array_join(F.concat("args", "kwargs"), ", ")
    ).otherwise(F.array_join("args", ", "))


def _told(parsed: DataFrame, arg_chars: int | None) -> DataFrame:
    """Syntax rows with the kind, arguments and text of statements."""
    node, vk, arg, low = F.col("node"), F.col("value_kind"), F.col("arg_text"), F.col("low")
    kind = (
        F.when(node == "if", "IF CHECK")
        .when(node == "def", "DEF FUNCTION")
        .when((node == "assign") & (vk == "call") & has_config_word(low), "CONFIG")
        .when((node == "assign") & (vk == "call"), "ASSIGN")
        .when((node == "assign") & (vk == "dict"), "DATA_STRUCT")
        .when((node == "assign") & (vk == "str"), "CONSTANT")
        .when((node == "call") & ~is_log_call(F.col("callee")), "ACTION")
        .when((node == "call") & F.col("value").isNotNull(), "LOG_EVENT")
        .otherwise("SILENT")
    )
    k, target, callee, value = F.col("kind"), F.col("target"), F.col("callee"), F.col("value")
    short = start_of(arg, arg_chars, "...")
    said = (
        F.when(k == "IF CHECK", F.concat(F.lit("IF CHECK: "), value))
        .when(k == "DEF FUNCTION", F.concat(F.lit("DEF FUNCTION "), target, F.lit(":")))
        .when(k == "CONFIG", F.concat(F.lit("CONFIG: "), target, F.lit(" = "), callee, F.lit("("), arg, F.lit(")")))
        .when(k == "ASSIGN", F.concat(F.lit("ASSIGN: "), target, F.lit(" = CALL "), callee, F.lit("("), short, F.lit(")")))
        .when(k == "DATA_STRUCT", F.concat(F.lit("DATA_STRUCT: "), target, F.lit(" = Keys["), arg, F.lit("]")))
        .when(k == "CONSTANT", F.concat(F.lit("CONSTANT: "), target, F.lit(' = "'), value, F.lit('"')))
        .when(k == "LOG_EVENT", F.concat(F.lit('LOG_EVENT: "'), value, F.lit('"')))
        .when(k == "ACTION", F.concat(F.lit("ACTION: "), callee, F.lit("("), short, F.lit(")")))
    )
    none = F.array().cast("array<string>")
    return (
        parsed.withColumns({"args": F.coalesce("args", none), "kwargs": F.coalesce("kwargs", none)})
        .withColumn("arg_text", _arg_text())
        .withColumn("low", F.when((node == "assign") & (vk == "call"), F.lower(arg)))  # once, not once for each word
        .withColumn("kind", kind)
        .withColumn("text", F.concat(F.repeat(F.lit("  "), F.col("indent")), said))
    )


def statement_facts(parsed: DataFrame, arg_chars: int | None = None) -> DataFrame:
    """(repo_id, path, seq, line, indent, node, kind, target, callee, args, value, arg_text, text).

    ``kind`` SILENT marks statements that print nothing themselves but still
    count for comment attachment.
    """
    return _told(parsed.filter(F.col("seq").isNotNull()), arg_chars).select(
        "repo_id", "path", "seq", "line", "indent", "node", "kind", "target", "callee", "args", "value", "arg_text", "text"
    )


def fact_errors(parsed: DataFrame) -> DataFrame:
    """(repo_id, path, error) for files that could not be parsed."""
    return parsed.filter(F.col("node") == "error").select("repo_id", "path", F.col("value").alias("error"))


def _with_notes(parsed: DataFrame, note: Column, arg_chars: int | None = None) -> DataFrame:
    """(repo_id, path, seq, line, node, text, after, notes): files, faults and statements, and the comments that may belong to them.

    ``note`` is a comment's struct, made of its ``line``, ``ctext`` and ``ctype``. A comment reaches
    its own line and the two after it, so a statement's notes are a frame of three lines. The bound
    "after the previous branch or assignment" is a running value over the file. One shuffle by
    file serves both, and what is grouped by file behind them. Files and faults take part as line 0.
    """
    file = ["repo_id", "path"]
    is_note, fault = F.col("node") == "comment", F.col("node") == "error"
    before = (
        Window.partitionBy(*file).orderBy(F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    )
    bound = F.last(F.when(F.col("node").isin("if", "assign"), F.col("line")), ignorenulls=True).over(before)
    near = Window.partitionBy(*file).orderBy("line").rangeBetween(-2, 0)
    # no filter on comments: it would be tested below the columns it reads, and make each of them several times
    kept = is_note & (F.col("ctext") != "") & (F.col("ctype") != "todo")
    text = F.when(is_note, F.col("value")).when(fault, F.concat(F.lit("Error parsing script: "), "value")).otherwise(F.col("text"))
    told = _told(parsed, arg_chars).select(*file, "seq", F.coalesce("line", F.lit(0)).alias("line"), "node", text.alias("text"))
    return (
        _by_file(told)
        .withColumn("after", F.coalesce(bound, F.lit(0)))
        .withColumn("ctext", comment_text(F.when(is_note, F.col("text"))))
        .withColumn("start", comment_start(F.col("ctext")))
        .withColumn("ctype", comment_class(F.col("ctext"), F.col("start")))
        .withColumn("notes", F.collect_list(F.when(kept, note)).over(near))
        .filter(~is_note)
        .select(*file, "seq", "line", "node", "text", "after", "notes")
    )


def _takes(c: Column) -> Column:
    """Whether the statement of the row takes one of its notes."""
    return F.col("node").isin("if", "assign", "call") & (c["cline"] > F.col("after"))


def attach_comments(parsed: DataFrame) -> DataFrame:
    """(repo_id, path, seq, line, comment_line, text, type) for each comment of each statement."""
    return (
        _with_notes(parsed, F.struct(F.col("line").alias("cline"), "ctext", "ctype"))
        .select("repo_id", "path", "seq", "line", "node", "after", F.explode("notes").alias("c"))
        .filter(_takes(F.col("c")))
        .select(
            "repo_id", "path", "seq", "line", F.col("c.cline").alias("comment_line"),
            F.col("c.ctext").alias("text"), F.col("c.ctype").alias("type"),
        )
    )


def format_comment(text: Column, kind: Column, chars: int | None = None) -> Column:
    rule = "=" * 70
    return (
        F.when(kind == "section_header", F.concat(F.lit(f"\n{rule}\n"), text, F.lit(f"\n{rule}")))
        .when(kind == "step_marker", F.concat(F.lit("\n>>> "), text))
        .when(kind == "docstring", F.concat(F.lit("  ## "), start_of(text, chars, "...")))
        .otherwise(F.concat(F.lit("  # "), text))
    )


def render_skeleton(
    parsed: DataFrame, include_comments: bool = True, arg_chars: int | None = None, comment_chars: int | None = None
) -> DataFrame:
    """(repo_id, path, skeleton): each file's statements and comments as text, or its fault.

    The group is one file, so it is no larger than what that file holds.
    """
    formed = format_comment(F.col("ctext"), F.col("ctype"), comment_chars)
    own = F.struct("seq", F.lit(2**31 - 1).alias("at"), "text")
    comments_first = F.transform(
        F.filter("notes", _takes),
        lambda c: F.struct(F.col("seq").alias("seq"), c["cline"].alias("at"), c["formed"].alias("text")),
    )
    said = F.array_compact(F.array(F.when(F.col("text").isNotNull(), own)))
    return (
        _with_notes(parsed, F.struct(F.col("line").alias("cline"), formed.alias("formed")), arg_chars)
        .select("repo_id", "path", (F.concat(comments_first, said) if include_comments else said).alias("rows"))
        .groupBy("repo_id", "path")
        .agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
        .select("repo_id", "path", F.array_join("rows.text", "\n").alias("skeleton"))
    )


# How settings appear in source lines.
ENV_KEY = r"""(?:getenv\(|environ\[|environ\.get\()\s*["']([^"']+)["']"""
FETCH_KEY = r"""\.fetch\(\s*["']([^"']+)["']"""
LITERAL = r"""(\w+)\s*=\s*(\d+(?:\.\d+)?|"[^"]*"|'[^']*')"""


def config_facts(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, kind, key, value): environment keys, looked-up keys and literal settings."""
    row = F.col("row")

    def keys(pattern: str, kind: str) -> Column:
        return F.transform(
            F.regexp_extract_all(row, F.lit(pattern), F.lit(1)),
            lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit(None).cast("string").alias("value")),
        )

    literals = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(row, F.lit(LITERAL), F.lit(1)).alias("k"),
            F.regexp_extract_all(row, F.lit(LITERAL), F.lit(2)).alias("v"),
        ),
        lambda kv: F.struct(
            F.lit("literal").alias("kind"), kv["k"].alias("key"), F.btrim(kv["v"], F.lit("\"'")).alias("value")
        ),
    )
    return (
        files.select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("i", "row"))
        .filter(row.contains("=") | row.contains("environ") | row.contains("getenv") | row.contains("fetch"))
        .select(
            "repo_id", "path", (F.col("i") + 1).alias("line"),
            F.explode(F.concat(keys(ENV_KEY, "env"), keys(FETCH_KEY, "fetch"), literals)).alias("c"),
        )
        .select("repo_id", "path", "line", "c.kind", "c.key", "c.value")
    )


def config_inventory(facts: DataFrame) -> DataFrame:
    """(key, uses, values, repos): how often and how differently each key is set."""
    return facts.groupBy("key").agg(
        F.count(F.lit(1)).alias("uses"),
        F.countDistinct("value").alias("values"),
        F.countDistinct("repo_id").alias("repos"),
    )


def config_values(facts: DataFrame) -> DataFrame:
    """(key, value, uses, repos): every value of every key, one row each."""
    return facts.groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("uses"), F.countDistinct("repo_id").alias("repos")
    )


def project_context(
    files: DataFrame, parsed: DataFrame, include_comments: bool = True, preview_chars: int | None = None
) -> DataFrame:
    """(repo_id, path, block, block_chars): one context block per readable source file.

    Blocks in path order are a repository's context. They stay rows: a
    repository can be far larger than one value may be. Python files give
    their skeleton, or the parse fault; other sources their text, or
    its start if ``preview_chars`` is given.
    """
    other = files.filter(F.col("ext").isin(".js", ".ts", ".java") & F.col("content").isNotNull())
    preview = other.select(
        "repo_id", "path",
        F.concat(
            F.lit("\n--- FILE: "), "path", F.lit(" ---\n"), start_of(F.col("content"), preview_chars), F.lit("\n")
        ).alias("block"),
    )
    scripts = render_skeleton(parsed, include_comments).select(
        "repo_id", "path",
        F.concat(F.lit("\n--- PIPELINE: "), "path", F.lit(" ---\n"), "skeleton", F.lit("\n")).alias("block"),
    )
    return preview.unionByName(scripts).withColumn("block_chars", F.length("block").cast("long"))


def context_size(context: DataFrame) -> DataFrame:
    return context.groupBy("repo_id").agg(F.sum("block_chars").alias("total_chars"))
