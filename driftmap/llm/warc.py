"""WARC archives: written as one gzip stream, normalised to a member a record, read by offset.

Archives lie below the folder that the cluster shares. A monolithic archive is one
gzip stream over all its records, which allows no access to a single one. The
normaliser inflates such a stream once, in pieces, and writes every record as a gzip
member of its own beside an index of offsets. A payload that an index of digests
knows from another record is written as a revisit to that.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm.cuts import cut
from driftmap.session import shared_dir

#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which a new archive begins.
ARCHIVE_BYTES = 32 << 20
#: Tasks over which archives are spread at most.
MOST_TASKS = 20_000
_PIECE = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Whole:
    """A file that is there under its name only when it is complete, whichever attempt wrote it."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = _at(path)
        context = TaskContext.get()
        self.part = f"{self.path}.{context.taskAttemptId() if context else 0}.part"
        self.fs.create_dir(self.path.rpartition("/")[0])

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def _line(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " and c != "\x7f" else quote(c) for c in value)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces; what a cut-off member still gives is given."""
    reader = zlib.decompressobj(31)
    while piece := source.read(_PIECE):
        while piece:
            yield reader.decompress(piece)
            piece = reader.unused_data
            if reader.eof:
                reader = zlib.decompressobj(31)
            else:
                break


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each complete record of a stream; one record is held at a time."""
    buffer = bytearray()

    def fill(enough) -> bool:
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while fill(lambda: b"\r\n\r\n" in buffer):
        end = buffer.index(b"\r\n\r\n")
        lines = bytes(buffer[:end]).decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        headers = dict(x.partition(": ")[::2] for x in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if not fill(lambda stop=stop: len(buffer) >= stop + 4):
            return
        yield headers, bytes(buffer[end + 4:stop])
        del buffer[:stop + 4]


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a response."""
    return block[block.index(b"\r\n\r\n") + 4:]


def written(pages: DataFrame, folder: str) -> DataFrame:
    """(archive, number, page_id, payload_bytes, payload_digest) of pages (page_id, url, html), written to monolithic archives.

    Each task begins a new archive after ``ARCHIVE_BYTES``. Null html is an empty
    payload, a null url or page_id an absent header.
    """

    def write(batches):
        task = TaskContext.get().partitionId()
        rows = ((r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass")) for batch in batches for r in batch.to_pylist())
        row, n = next(rows, None), 0
        while row is not None:
            path = f"{folder}/whole/part-{task:06d}-{n:04d}.warc.gz"
            out, size, index = zlib.compressobj(1, wbits=31), 0, []
            with _Whole(path) as file:
                while row is not None and size < ARCHIVE_BYTES:
                    page_id, url, payload = row
                    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:x-record:{task}-{n}-{len(index)}>", "WARC-Date": "1970-01-01T00:00:00Z",
                               "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": _sha1(payload)}
                    headers |= {} if url is None else {"WARC-Target-URI": url}
                    headers |= {} if page_id is None else {"X-Page-Id": str(page_id)}
                    data = record(headers, _HTTP % len(payload) + payload)
                    file.write(out.compress(data))
                    size += len(data)
                    index.append((page_id, len(payload), hashlib.sha1(payload).hexdigest()))
                    row = next(rows, None)
                file.write(out.flush())
            ids, sizes, digests = zip(*index, strict=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([path] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
            ], names=["archive", "number", "page_id", "payload_bytes", "payload_digest"])
            n += 1

    return pages.select("page_id", "url", "html").mapInArrow(write, "archive string, number long, page_id long, payload_bytes long, payload_digest string")


def revisits(index: DataFrame) -> DataFrame:
    """(archive, number, refers_to) of the records that repeat another one's payload of ``REVISIT_BYTES`` or more.

    The record with the largest page_id stays, of repeated rows of a page the last
    one. Records without page_id stay.
    """
    known = index.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    last = known.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "archive", "number")).alias("last"), F.count(F.lit(1)).alias("n"))
    both = known.join(last.where("n > 1"), ["payload_digest", "payload_bytes"])
    return both.where(F.struct("page_id", "archive", "number") != F.col("last")).select("archive", "number", F.col("last.page_id").alias("refers_to"))


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, offset, length, record_type) of every record of ``archives`` (archive, numbers, refers_to), rewritten below ``folder``.

    ``numbers`` and ``refers_to`` are arrays: the records of the archive to write as
    revisits, and the pages they refer to. Each archive is read once, from its start
    to its end, and gets a file of members and a sidecar ``.idx`` with a JSON line
    for each of them. Records of other types are rewritten as they are.
    """

    def rewrite(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known = dict(zip(row["numbers"] or (), row["refers_to"] or (), strict=True))
                path = f"{folder}/records/{row['archive'].rpartition('/')[2]}"
                index, offset = [], 0
                fs, source = _at(row["archive"])
                with fs.open_input_stream(source, compression=None) as file, _Whole(path) as out:
                    for number, (headers, block) in enumerate(records(inflated(file))):
                        headers.pop("Content-Length")
                        if number in known:
                            payload = payload_of(block)
                            block = block[: len(block) - len(payload)]
                            headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                                        "X-Refers-To-Page": str(known[number]), "X-Payload-Length": str(len(payload))}
                        member = zlib.compressobj(6, wbits=31)
                        data = member.compress(record(headers, block)) + member.flush()
                        out.write(data)
                        index.append((offset, len(data), headers.get("WARC-Type", "")))
                        offset += len(data)
                with _Whole(f"{path}.idx") as out:
                    for at, length, kind in index:
                        out.write((json.dumps({"offset": at, "length": length, "type": kind}) + "\n").encode())
                for start in range(0, len(index), 10_000):
                    at, lengths, kinds = zip(*index[start:start + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(lengths, pa.int64()), pa.array(kinds, pa.string()),
                    ], names=["archive", "offset", "length", "record_type"])

    return archives.mapInArrow(rewrite, "archive string, offset long, length long, record_type string")


def read_back(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records at the offsets of ``index``.

    Each is one seek and one member. A response is digested anew and compared with
    what its header says; a revisit has the figures in its header only.
    """

    def read(batches):
        for batch in batches:
            rows, opened, file = [], None, None
            for r in batch.to_pylist():
                if r["archive"] != opened:
                    opened = r["archive"]
                    fs, path = _at(opened)
                    file = fs.open_input_file(path)
                file.seek(r["offset"])
                headers, block = next(records(inflated(io.BytesIO(file.read(r["length"])))))
                stored, said = headers["WARC-Payload-Digest"], headers["WARC-Type"]
                digest = base64.b32decode(stored.removeprefix("sha1:")).hex()
                if said == "revisit":
                    size, refers = int(headers["X-Payload-Length"]), int(headers["X-Refers-To-Page"])
                else:
                    payload, refers = payload_of(block), None
                    size = len(payload)
                    if _sha1(payload) != stored:
                        raise ValueError(f"{opened} at {r['offset']}: the payload is not what its digest says")
                page = headers.get("X-Page-Id")
                rows.append((None if page is None else int(page), size, digest, said, refers))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("archive", "offset", "length").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """What the archives of ``pages`` (page_id, url, html) hold, one row per row: written, normalised and read back.

    Null html is an empty payload; a null page_id stays null and such a record is
    always a response. Of repeated rows of a page one is the response if none with a
    larger id has its payload. Other columns are not read. An empty table gives no rows.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    index = cut(written(pages, folder))
    known = revisits(index).groupBy("archive").agg(F.collect_list(F.struct("number", "refers_to")).alias("known"))
    archives = cut(
        index.select("archive").distinct().join(known, "archive", "left")
        .select("archive", F.col("known.number").alias("numbers"), F.col("known.refers_to").alias("refers_to"))
    )
    # a few bytes a row, but much work: not to be put together in few tasks
    spread = archives.repartition(max(1, min(archives.count(), MOST_TASKS)), "archive")
    return read_back(cut(normalised(spread, folder)))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
