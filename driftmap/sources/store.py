"""Small files that are written once: pointers and manifests, numbered from 0.

A file is written under another name and then renamed, which fails if its name is
taken. So of two writers of one number one wins, wherever a rename without overwrite
is atomic (HDFS and file systems like it); a reader never sees half a file.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first; read again and decide anew."""


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def entries(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder with the milliseconds of their last change; none if there is no folder."""
    fs, where = _system(spark, folder)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(where)} if fs.exists(where) else {}


def text_of(spark: SparkSession, path: str) -> str:
    fs, where = _system(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _system(spark, path)
    fs.delete(where, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write the file unless there is one of that name; whether this call wrote it."""
    folder, _, name = path.rpartition("/")
    fs, draft = _system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs.mkdirs(draft.getParent())
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getParent().toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(path), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """Number and content of the last file of a numbered folder."""
    numbers = [int(n) for n in entries(spark, folder) if n.isdigit()]
    return (max(numbers), json.loads(text_of(spark, f"{folder}/{max(numbers):012d}"))) if numbers else None


def numbered(spark: SparkSession, folder: str) -> list[tuple[int, dict, int]]:
    """(number, content, milliseconds of its writing) of all files, in order."""
    found = sorted((int(n), at) for n, at in entries(spark, folder).items() if n.isdigit())
    return [(n, json.loads(text_of(spark, f"{folder}/{n:012d}")), at) for n, at in found]


def append(spark: SparkSession, folder: str, after: int, content: dict) -> None:
    """Write the file behind number ``after`` (-1: the first); a ``Conflict`` if there is one."""
    if not create_once(spark, f"{folder}/{after + 1:012d}", json.dumps(content)):
        raise Conflict(f"{folder} has a number {after + 1} already")
