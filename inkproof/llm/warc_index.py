"""WARC archives with a two-level capture index.

Archives: one gzip member a record, written by tasks through pyarrow's file systems to a folder that
all executors share (a URI). A task that is run again writes a file of another name; only files that
the captures name are ever read.

Index: captures in the order of (reversed-host key, sequence) in compressed blocks, one file for each
range. Each file ends with its sparse directory: the first capture of every block. The list of the
files' ranges is the top level; its size is the number of shuffle partitions. A lookup finds the file
and then the block by binary search, reads that block, finds the capture in it and reads its record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa

import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import shared_folder, stored

#: Least payload for which an equal one is only referred to; captures in a block; lookups handled at once; largest gap read over.
LEAST_SHARED, BLOCK_ROWS, LOOKUPS, GAP = 1000, 1000, 256, 1 << 16
NO_ID = -(1 << 63)
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: Column) -> Column:
    """Reversed host, ) and what follows without the fragment; A-Z of the host lower-cased. Null: empty."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?]*(.*)$", 1))


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, key, html, digest, size, record_type, refers_to: equal payloads point to the largest page_id.

    Only groups of two or more are joined back; the largest group may hold any share of the rows.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", url_key(F.col("url")).alias("key"), payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    groups = (
        rows.filter(F.col("size") >= LEAST_SHARED).groupBy("digest", "size")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    )
    groups = stored(groups, "equal-payloads")
    rows = rows.join(groups, ["digest", "size"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return rows.select(
        "page_id", "url", "key", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"))


def record(page_id: object, url: str | None, html: bytes, digest: str, kind: str, refers_to: object, date: str) -> bytes:
    """One WARC record. The block of a revisit is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (html if kind == "response" else b"")
    name = lambda x: "" if x is None else str(x)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name(page_id)}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{name(refers_to)}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC header fields (lower-case names), HTTP header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _write(folder: str, date: str):
    def run(batches):
        out = None
        offset, name = 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    fs, path = arrow_fs.FileSystem.from_uri(folder)
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["record_type"], r["refers_to"], date)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                rows.append((r["key"], NO_ID if r["page_id"] is None else r["page_id"], name, offset, len(member)))
                offset += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["key", "seq", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the records and returns the captures: key, seq (the page_id), file, offset, length."""
    rows = with_types(pages)
    return stored(rows.mapInArrow(_write(folder, date), "key string, seq long, file string, offset long, length long"), "captures")


def _pack(folder: str):
    """Sorted captures to one index file a partition; yields its range: first and last capture and name."""

    def run(batches):
        out, at, directory, held, first, last = None, 0, [], [], None, None
        tool = zstandard.ZstdCompressor(level=3)

        def flush():
            nonlocal at, held
            block = tool.compress(json.dumps(held).encode())
            out.write(block)
            directory.append((held[0][0], held[0][1], at, len(block)))
            at += len(block)
            held = []

        name = f"{uuid.uuid4().hex}.index"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, path = arrow_fs.FileSystem.from_uri(folder)
                    fs.create_dir(path, recursive=True)
                    out, first = fs.open_output_stream(f"{path}/{name}", compression=None), row
                held.append(row)
                last = row
                if len(held) == BLOCK_ROWS:
                    flush()
        if out is not None:
            if held:
                flush()
            tail = tool.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (first[0], first[1], last[0], last[1], name)], names=["first_key", "first_seq", "last_key", "last_seq", "file"])

    return run


def build_index(captures: DataFrame, folder: str) -> list[tuple[bytes, int, bytes, int, str]]:
    """Writes the index files; returns the top level, a row for each file in the order of their ranges."""
    ordered = captures.repartitionByRange("key", "seq").sortWithinPartitions("key", "seq")
    tops = ordered.mapInArrow(_pack(folder), "first_key string, first_seq long, last_key string, last_seq long, file string")
    rows = stored(tops, "ranges").collect()  # a row for each shuffle partition at most
    return sorted((r.first_key.encode(), r.first_seq, r.last_key.encode(), r.last_seq, r.file) for r in rows)


class Index:
    """Lookups in the files that build_index has written; keeps the last directory and block."""

    def __init__(self, top: list[tuple[bytes, int, bytes, int, str]], folder: str) -> None:
        self.top, self.fs, self.path = top, *arrow_fs.FileSystem.from_uri(folder)
        self.starts = [t[:2] for t in top]
        self.file = self.directory = self.block = None
        self.block_at = (-1, -1)

    def find(self, key: bytes, seq: int) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key and sequence."""
        at = bisect.bisect_right(self.starts, (key, seq)) - 1
        if at < 0 or self.top[at][2:4] < (key, seq):
            return []
        if self.block_at[0] != at:
            self.file = self.fs.open_input_file(f"{self.path}/{self.top[at][4]}")
            size = self.file.size()
            tail = int.from_bytes(self.file.read_at(8, size - 8), "little")
            rows = json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(tail, size - 8 - tail)))
            self.directory = [((r[0].encode(), r[1]), r[2], r[3]) for r in rows]
            self.block_at = (at, -1)
        found = []
        b = max(0, bisect.bisect_left(self.directory, ((key, seq),)) - 1)
        while b < len(self.directory) and self.directory[b][0] <= (key, seq):
            if self.block_at != (at, b):
                _, offset, length = self.directory[b]
                rows = json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, offset)))
                self.block = [((r[0].encode(), r[1]), *r[2:]) for r in rows]
                self.block_at = (at, b)
            i = bisect.bisect_left(self.block, ((key, seq),))
            while i < len(self.block) and self.block[i][0] == (key, seq):
                found.append(self.block[i][1:])
                i += 1
            b += 1
        return found


def ranges(wanted: list[tuple[str, int, int]], folder: str) -> Iterator[bytes]:
    """The gzip members at (file, offset, length), read file by file in order; near ones in one read."""
    fs, path = arrow_fs.FileSystem.from_uri(folder)
    wanted = sorted(wanted)
    i = 0
    while i < len(wanted):
        file, start, length = wanted[i]
        end, j = start + length, i + 1
        while j < len(wanted) and wanted[j][0] == file and wanted[j][1] - end <= GAP:
            end = max(end, wanted[j][1] + wanted[j][2])
            j += 1
        with fs.open_input_file(f"{path}/{file}") as f:
            data = f.read_at(end - start, start)
        for _, offset, length in wanted[i:j]:
            yield data[offset - start:offset - start + length]
        i = j


def _read(top, index_folder: str, archive_folder: str, with_payload: bool):
    number = lambda urn: int(x) if (x := urn[10:-1]) else None

    def run(batches):
        index = Index(top, index_folder)
        for batch in batches:
            keys, seqs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in range(0, len(keys), LOOKUPS):
                wanted = [w for k, s in zip(keys[part:part + LOOKUPS], seqs[part:part + LOOKUPS], strict=True) for w in index.find(k.encode(), s)]
                rows = []
                for member in ranges(wanted, archive_folder):
                    fields, http, payload = parsed(zlib.decompress(member, 31))
                    digest = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
                    kind = fields["warc-type"]
                    if kind == "response":
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"record {fields['warc-record-id']}: the payload does not have its digest")
                    else:
                        size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
                    rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, number(fields.get("warc-refers-to", "<urn:page:>")), payload if with_payload and kind == "response" else None))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def lookup(wanted: DataFrame, top: list, index_folder: str, archive_folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all captures of the wanted (key, seq), each pair looked up once, in ranges of the key order.

    payload is null for revisits: refers_to names the record that has it.
    """
    ordered = stored(wanted.select("key", "seq").distinct(), "wanted").repartitionByRange("key", "seq").sortWithinPartitions("key", "seq")
    return ordered.mapInArrow(
        _read(top, index_folder, archive_folder, with_payload),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read back from archives of all pages.

    Null html is an empty payload, a null url has the empty key and no target in its record. Repeated rows
    are records of their own; all that carry the largest page_id of equal payloads are responses.
    Rows without a page_id can only refer to others; if a whole group has none, all are responses.
    """
    folder = shared_folder(pages.sparkSession)
    archives, index = f"{folder}-archives", f"{folder}-index"
    captures = write_archives(pages, archives)
    top = build_index(captures, index)
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("seq"))
    return lookup(wanted, top, index, archives, with_payload=False).drop("payload", "url")
