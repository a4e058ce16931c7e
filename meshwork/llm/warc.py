"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writing: equal payloads of MIN_REVISIT bytes or more are one response, of the largest page_id, and revisits
of it. Which row is which is decided on digests alone; payloads don't move while the decisions on what repeats are small
enough to be broadcast, and once, to the join with them, beyond.
Each task writes archives of about ROLL bytes into the shared folder under names of its own attempt and
returns their paths; only the paths of tasks that succeeded reach the manifest, so that what a lost or
repeated task has left behind is never read.

Reading: an archive's dictionary is loaded from its skippable frame, each frame is cut out by its block
headers and must hold one whole record; version, required headers, lengths, the frame's checksum and, for
responses, the payload's digest are verified.

Defined results: null html is an empty payload; null urls are written as an x-page URI and read as null;
blanks, line breaks and what is not ASCII in a url are percent-encoded; rows
that share the largest page_id of a payload are all responses; a null page_id is only a response where no row
of its payload has one, and such rows are then all responses; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.session import cut, qualified, work_folder

MIN_REVISIT, ROLL, LEVEL = 1000, 8 << 20, 6
#: Bytes of a dictionary, records that it is trained on.
DICTIONARY, TRAIN_ON = 32 << 10, 200
#: The skippable frame that holds a dictionary; the frame magic of Zstandard.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Rows of pages with payload (null for revisits), payload_bytes, digest (hex) and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"))
    large = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", F.col("digest").alias("same"))
    several = large.groupBy("same").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1 and holder is not null").select("same", "holder")
    # kept, so that its size is known: payloads stay where they are while what repeats is small enough to be broadcast
    several = cut(several)
    # small pages have keys of their own that nothing meets, not one key for all
    key = F.when(F.col("payload_bytes") >= min_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "digest").cast("string")))
    rows = rows.join(several, key == F.col("same"), "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "digest", F.when(revisit, F.col("holder")).alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    target = _uri(page_id) if url is None else quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_uri(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """An archive in the making."""

    def __init__(self, dictionary: zstandard.ZstdCompressionDict | None):
        self.parts = [SKIPPABLE + struct.pack("<I", len(d := dictionary.as_bytes())) + d] if dictionary else []
        self.size, self.records = sum(map(len, self.parts)), 0
        self.to = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)

    def add(self, one: bytes) -> None:
        frame = self.to.compress(one)
        self.parts.append(frame)
        self.size += len(frame)
        self.records += 1


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; None where samples are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:
        return None


def frames(data: bytes) -> tuple[bytes | None, list[tuple[int, int]]]:
    """(dictionary, (start, end) of each frame), from frame and block headers alone."""
    at, dictionary, found = 0, None, []
    while at < len(data):
        if 0x50 <= data[at] <= 0x5F and data[at + 1 : at + 4] == SKIPPABLE[1:]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame breaks off")
            if at == 0 and data[:4] == SKIPPABLE:
                dictionary = data[8 : 8 + size]
                if dictionary[:4] == FRAME:
                    dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
            at += 8 + size
            continue
        if data[at : at + 4] != FRAME:
            raise ValueError("not a Zstandard frame")
        start, checksum = at, data[at + 4] >> 2 & 1
        at += zstandard.frame_header_size(data[at : at + 18])
        last = 0
        while not last:
            if at + 3 > len(data):
                raise ValueError("a frame breaks off")
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            at += 3 + (1 if kind == 1 else size)
        at += 4 * checksum
        if at > len(data):
            raise ValueError("a frame breaks off")
        found.append((start, at))
    return dictionary, found


def parse(one: bytes) -> dict:
    """A record's fields; ValueError where version, headers, lengths or digest are wrong."""
    head, sep, rest = one.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    h = dict(line.split(": ", 1) for line in lines[1:])
    if missing := [k for k in REQUIRED if k not in h]:
        raise ValueError(f"a record lacks {missing}")
    size = int(h["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    told = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length: ")).split(": ")[1])
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = h["WARC-Type"]
    if kind == "response":
        if len(payload) != told or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a response's payload is not what its headers say")
    elif kind != "revisit" or payload or h.get("WARC-Profile") != PROFILE or "WARC-Refers-To" not in h:
        raise ValueError("not a response or a whole revisit")

    def page(uri: str) -> int | None:
        value = uri.removeprefix("<urn:x-page:").removesuffix(">")
        return None if value == "none" else int(value)

    me = page(h["WARC-Record-ID"])
    url = h.get("WARC-Target-URI")
    return {"page_id": me, "url": None if url == _uri(me) else url, "payload_bytes": told, "payload_digest": digest, "record_type": kind, "refers_to": page(h["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """The manifest (path, records, bytes) of the archives that hold a record per row of pages (page_id, url, html)."""
    folder = qualified(pages.sparkSession, folder) if folder else work_folder(pages.sparkSession, "warc")
    folder = folder if "://" in folder else folder.replace("file:/", "file:///", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, count, archive = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None

        def close(a: Archive) -> pa.RecordBatch:
            with store.open_output_stream(f"{name}-{count:04d}.warc.zst") as f:
                f.write(b"".join(a.parts))
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{count:04d}.warc.zst"]), pa.array([a.records], pa.int64()), pa.array([a.size], pa.int64())], ["path", "records", "bytes"])

        dictionary = None
        for b in batches:
            columns = [b.column(i) for i in range(6)]
            row = lambda i: record(*(c[i].as_py() for c in columns))  # noqa: B023, E731
            if archive is None and b.num_rows:
                dictionary = _dictionary([row(i) for i in range(min(TRAIN_ON, b.num_rows))])
            for i in range(b.num_rows):
                archive = archive or Archive(dictionary)
                archive.add(row(i))
                if archive.size >= ROLL:
                    yield close(archive)
                    archive, count = None, count + 1
        if archive:
            yield close(archive)

    manifest = decide(pages, min_bytes).mapInArrow(run, "path string, records long, bytes long")
    return cut(manifest.withColumn("root", F.lit(folder.split("://")[0] + "://" + folder.split("://")[1].split("/")[0])))


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records of the archives."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), **({"payload": pa.binary()} if payloads else {})}
    spark_type = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, records, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, _ = fs.FileSystem.from_uri(f"{root}/")
                with store.open_input_stream(path) as f:
                    data = f.read()
                dictionary, spans = frames(data)
                if len(spans) != records:
                    raise ValueError(f"{path} holds {len(spans)} records, not {records}")
                of = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                for at in range(0, len(spans), 500):
                    rows = [parse(of.decompress(data[a:z])) for a, z in spans[at : at + 500]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return manifest.select("path", "records", "root").mapInArrow(run, ", ".join(f"{k} {spark_type[t]}" for k, t in kinds.items()))
