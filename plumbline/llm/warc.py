"""Normaliser for WARC files that were compressed as a whole.

A monolithic .warc.gz is one gzip stream, so no record can be reached without
inflating all before it. The normaliser inflates the stream once, in pieces,
writes every record as a gzip member of its own and, beside the file, an index
of offsets (one JSON object a line). One task handles one file, in memory that
grows with neither file nor record: a member that outgrows HELD is kept in a
side file next to the target until its record is known to be complete, and
index lines are written as they come. Output goes to a name of its own and is
moved into place, so a lost or repeated task leaves a whole file or none.

Files are opened through pyarrow's file systems: local and mounted folders,
HDFS, S3, GCS.

Defined cases: several members in the input are read through. A file that ends
inside a record, or whose data are damaged, keeps its complete records and no
byte of another, and the index gets a last row whose error says why (offset and
length null); a header of more than HEADER bytes counts as damage. An empty
file gives an empty file and no rows. Targets keep the folders of the inputs
below the folder that all inputs share, so files of one name don't meet; an
input named twice is normalised once. ``write_monolithic`` writes null html as an
empty payload and leaves out the address of a null url; repeated pages are
records of their own. Line breaks in a url are escaped. An empty table gives no
rows. Further columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .storage import scratch

PIECE = 1 << 20
#: Bytes of a member that are held in memory, and the most that a header may have.
HELD, HEADER = 16 << 20, 16 << 20
#: Rows of an index that travel together.
ROWS = 10_000
_END = b"\r\n\r\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1)) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class _Inflated:
    """Bytes of a gzip stream of one or more members, read in pieces."""

    def __init__(self, raw) -> None:  # noqa: ANN001
        self.raw, self.buffer, self.error = raw, bytearray(), None
        self.inflate = zlib.decompressobj(31)
        self.ended = False
        self.rest = b""

    def _more(self) -> bool:
        if self.ended:
            return False
        try:
            data = self.rest or self.raw.read(PIECE)
            self.rest = b""
            if not data:
                self.ended = True
                if not self.inflate.eof and self.touched:
                    self.error = "the gzip stream is cut off"
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(data, 4 * PIECE)
            self.touched = True
            self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
        except (zlib.error, OSError) as e:
            self.ended, self.error = True, f"damaged data: {e}"
            return False
        return True

    touched = False

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with mark; None if it doesn't come."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if seen > HEADER or not self._more():
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        """n bytes, fewer at the end."""
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip_blank(self) -> bool:
        """Skip line breaks between records; whether more follows."""
        while True:
            k = 0
            while k < len(self.buffer) and self.buffer[k] in b"\r\n":
                k += 1
            del self.buffer[:k]
            if self.buffer:
                return True
            if not self._more():
                return bool(self.buffer)


def records(raw) -> Iterator[tuple[str, dict[str, str], bytes, Iterator[bytes]] | tuple[str, str]]:  # noqa: ANN001
    """("record", fields, header bytes, payload pieces) of each record, and at last ("error", why) if the file is damaged.

    The pieces must be used up before the next record is asked for; a record
    whose payload ends early is reported by the error that follows.
    """
    data = _Inflated(raw)
    while data.skip_blank():
        head = data.until(_END)
        if head is None:
            yield "error", data.error or ("a record's header is cut off" if data.ended else "a record's header has no end")
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            yield "error", "no WARC record"
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}
        try:
            left = int(fields["content-length"])
        except (KeyError, ValueError):
            yield "error", "a record without content-length"
            return
        short = []

        def payload(left: int = left) -> Iterator[bytes]:
            while left > 0:
                piece = data.take(min(left, PIECE))
                if not piece:
                    short.append(True)
                    return
                left -= len(piece)
                yield piece

        yield "record", fields, head, payload()
        if short:
            yield "error", data.error or "a record's payload is cut off"
            return
    if data.error:
        yield "error", data.error


class _Member:
    """The gzip member of one record, in memory or, from HELD bytes on, in a side file."""

    def __init__(self, files: fs.FileSystem, side: str) -> None:
        self.files, self.side, self.out = files, side, None
        self.squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.held, self.waiting, self.size = [], 0, 0

    def add(self, data: bytes) -> None:
        self._keep(self.squeeze.compress(data))

    def _keep(self, data: bytes) -> None:
        self.held.append(data)
        self.waiting += len(data)
        self.size += len(data)
        if self.waiting > HELD:
            self.out = self.out or self.files.open_output_stream(self.side, compression=None)
            for x in self.held:
                self.out.write(x)
            self.held, self.waiting = [], 0

    def write(self, to) -> None:  # noqa: ANN001
        """End the member and append it to a stream."""
        self._keep(self.squeeze.flush())
        if self.out:
            self.out.close()
            with self.files.open_input_stream(self.side, compression=None) as side:
                while piece := side.read(PIECE):
                    to.write(piece)
        for x in self.held:
            to.write(x)

    def drop(self) -> None:
        if self.out:
            self.out.close()
            self.files.delete_file(self.side)


def normalise_file(source: str, target: str) -> Iterator[dict]:
    """Rewrite one file with a member a record, write its index beside it and return the index's rows."""
    ins, path = _open(source)
    outs, final = _open(target)
    temporary = f"{final}.{uuid.uuid4().hex}.tmp"
    with ins.open_input_stream(path, compression=None) as raw, outs.open_output_stream(temporary, compression=None) as out, outs.open_output_stream(f"{temporary}.idx", compression=None) as index:
        at = 0
        for kind, *rest in records(raw):
            if kind == "error":
                index.write(json.dumps({"error": rest[0]}).encode() + b"\n")
                break
            fields, head, pieces = rest
            member, digest, size = _Member(outs, f"{temporary}.rec"), hashlib.md5(), 0
            member.add(head)
            for piece in pieces:
                digest.update(piece)
                size += len(piece)
                member.add(piece)
            if size == int(fields["content-length"]):  # else the next item is the error
                member.add(_END)
                member.write(out)
                row = {"offset": at, "length": member.size, "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_md5": digest.hexdigest()}
                index.write(json.dumps(row).encode() + b"\n")
                at += member.size
            member.drop()
    outs.move(f"{temporary}.idx", f"{final}.idx")
    outs.move(temporary, final)
    return read_index(target)


def read_index(target: str) -> Iterator[dict]:
    """The rows of a normalised file's index."""
    files, inner = _open(target)
    with files.open_input_stream(f"{inner}.idx", compression=None) as f:
        rest = b""
        while piece := f.read(PIECE):
            *lines, rest = (rest + piece).split(b"\n")
            yield from map(json.loads, lines)


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record of a normalised file, by its index entry."""
    files, inner = _open(path)
    with files.open_input_file(inner) as f:
        f.seek(offset)
        text = zlib.decompress(f.read(length), 31)
    head, _, body = text.partition(_END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return fields, body[: int(fields["content-length"])]


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as whole-file compressed WARCs, one a partition; (path) of each. Eager only when used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = _open(folder)
        files.create_dir(inner, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        temporary = f"{inner}/{name}.{uuid.uuid4().hex}.tmp"
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        some = False
        with files.open_output_stream(temporary, compression=None) as out:
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    for page, url, html in zip(*(c.slice(k, 64).to_pylist() for c in b.columns)):
                        body = (html or "").encode()
                        address = "" if url is None else "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A") + "\r\n"
                        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n{address}Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
                        out.write(squeeze.compress(head.encode() + body + _END))
                        some = True
            out.write(squeeze.flush())
        files.move(temporary, f"{inner}/{name}")
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html")).mapInArrow(run, "path string")


def targets(paths: list[str], folder: str) -> dict[str, str]:
    """The target of each distinct input: its path below the folder that all inputs share, in folder."""
    parts = {p: p.replace("://", "/").strip("/").split("/") for p in paths}
    shared = 0
    while all(len(x) > shared + 1 and x[shared] == next(iter(parts.values()))[shared] for x in parts.values()):
        shared += 1
    found = {p: "/".join([folder, *x[shared:]]) for p, x in parts.items()}
    if len(set(found.values())) < len(found) or any(".." in x for x in parts.values()):
        raise ValueError("inputs whose targets can't be told apart")
    return found


def normalise(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """Normalise each file into folder; the rows of all indexes, file naming the new file."""
    schema = "file string, record_offset long, record_length long, type string, record_id string, url string, payload_bytes long, payload_md5 string, error string"
    names = ["offset", "length", "type", "record_id", "url", "payload_bytes", "payload_md5", "error"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    if not paths:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                files, inner = _open(target)
                files.create_dir(inner.rpartition("/")[0], recursive=True)
                rows = normalise_file(source, target)
                while part := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([target] * len(part), pa.string()), *(pa.array([x.get(n) for x in part], k) for n, k in zip(names, kinds))], [x.split()[0] for x in schema.split(", ")])

    # a task a file
    pairs = sorted(targets(paths, folder).items())
    rows = spark.createDataFrame(spark.sparkContext.parallelize(pairs, len(pairs)), "path string, target string")
    return rows.mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as monolithic WARCs, normalised: the index of every record."""
    folder = scratch(spark, "warc")
    paths = [r[0] for r in write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/in").collect()]
    index = normalise(spark, sorted(paths), f"{folder}/out")
    return index.selectExpr("cast(nullif(regexp_extract(record_id, 'urn:page:([0-9-]+)', 1), '') as bigint) as page_id", "url", "substring_index(file, '/', -1) as file", "record_offset", "record_length", "payload_bytes", "payload_md5", "error")
