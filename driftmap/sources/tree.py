"""Source trees as a ``files`` table: scan, hidden and ignored paths, extensions."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.session import checkpoint_root

# What the context scan reads, and what counts as a changed file.
SCAN_EXTENSIONS = [".py", ".js", ".ts", ".java"]
CHANGED_EXTENSIONS = [".py", ".js", ".ts", ".java"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Last suffix of the file name; a leading dot does not start one."""
    return F.regexp_extract(base_name(path), r"[^.].*(\.[^.]*)$", 1)


def directory(path: Column) -> Column:
    """Directory of a path, '' for the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


#: Files whose contents one partition reads; a level of folders is listed in about as many partitions.
FILES_PER_TASK, LISTING_TASKS = 256, 64


def _list_folders(batches):
    """Entries of each folder: one row per file or folder, of any name."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            fs, top = pafs.FileSystem.from_uri(row["root"])
            found = fs.get_file_info(pafs.FileSelector(f"{top}/{row['path']}".rstrip("/"), recursive=False))
            for e in found:
                inner = f"{row['path']}/{e.base_name}".lstrip("/")
                rows.append((row["repo_id"], row["root"], inner, e.type == pafs.FileType.Directory, e.size))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["repo_id", "root", "path", "folder", "n_bytes"])


def _read_contents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            fs, top = pafs.FileSystem.from_uri(row["root"])
            with fs.open_input_stream(f"{top}/{row['path']}", compression=None) as f:
                data = f.read()
            try:
                text = data.decode()
            except UnicodeDecodeError:
                text = None
            yield pa.RecordBatch.from_arrays([
                pa.array([row["repo_id"]]), pa.array([row["path"]]), pa.array([row["n_bytes"]], pa.int64()), pa.array([text], pa.string()), pa.array([text is not None]),
            ], names=["repo_id", "path", "n_bytes", "content", "readable"])


def list_files(roots: DataFrame) -> DataFrame:
    """(repo_id, root, path, n_bytes) of every file below the folders of ``roots`` (repo_id, root).

    Folders are listed level by level in distributed steps, so hidden names and
    names with an underscore in front, which Spark's own listing leaves out, are
    there. The driver only learns whether a level holds folders.
    """
    schema = "repo_id string, root string, path string, folder boolean, n_bytes long"
    checkpoint_root(roots.sparkSession)
    level, files = roots.select("repo_id", "root", F.lit("").alias("path")), []
    while True:
        found = level.repartition(LISTING_TASKS).mapInArrow(_list_folders, schema).checkpoint()
        files.append(found.where("NOT folder").select("repo_id", "root", "path", "n_bytes"))
        level = found.where("folder").select("repo_id", "root", "path")
        if level.limit(1).count() == 0:
            return reduce(DataFrame.union, files)


def read_files(listed: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """(repo_id, path, ext, n_bytes, content, readable) of listed files, with one of the extensions if any are given."""
    if exts:
        listed = listed.where(reduce(or_, (F.col("path").endswith(e) for e in exts)))
    tasks = max(1, -(-listed.count() // FILES_PER_TASK))
    schema = "repo_id string, path string, n_bytes long, content string, readable boolean"
    return listed.repartition(tasks, "repo_id", "path").mapInArrow(_read_contents, schema).select(
        "repo_id", "path", extension(F.col("path")).alias("ext"), "n_bytes", "content", "readable"
    )


def scan_files(spark: SparkSession, roots: dict[str, str], exts: list[str] | None = None) -> DataFrame:
    """The same for every file below the given roots, a folder by repo_id.

    Files that are not UTF-8 keep their row, without content.
    """
    return read_files(list_files(spark.createDataFrame([(r, d.rstrip("/")) for r, d in roots.items()], "repo_id string, root string")), exts)


def scan_fleet(spark: SparkSession, base: str, exts: list[str] | None = None) -> DataFrame:
    """The same for a folder that holds one folder per repository, however many there are."""
    files = scan_files(spark, {"": base}, exts).where(F.col("path").contains("/"))
    return files.withColumns({"repo_id": F.substring_index("path", "/", 1), "path": F.regexp_replace("path", "^[^/]+/", "")})


def prune_hidden(files: DataFrame) -> DataFrame:
    """Drop files below a hidden directory; hidden files themselves stay."""
    return files.filter(~F.col("path").rlike(r"(^|/)\.[^/]*/"))


def apply_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop files whose last matching rule is not negated.

    ``rules`` is (repo_id, seq, regex, negated): the lines of one ignore file
    per repository, which become one array row, so each file meets one row.
    """
    lists = rules.groupBy("repo_id").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("seq", "regex", "negated")))).alias("rules")
    )
    last = F.try_element_at(F.filter("rules", lambda r: F.rlike(F.col("path"), r["regex"])), F.lit(1))
    return (
        files.join(lists, "repo_id", "left")
        .filter(F.coalesce(last["negated"], F.lit(True)))
        .drop("rules")
    )


def filter_ext(files: DataFrame, extensions: list[str]) -> DataFrame:
    keep = F.lit(False)
    for e in extensions:
        keep = keep | F.col("path").endswith(e)
    return files.filter(keep)


def only_paths(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files named in ``changed`` (repo_id, path), with either kind of slash."""
    key = F.regexp_replace("path", r"\\", "/")
    wanted = changed.select("repo_id", key.alias("slashed")).distinct()
    return files.withColumn("slashed", key).join(wanted, ["repo_id", "slashed"], "left_semi").drop("slashed")
