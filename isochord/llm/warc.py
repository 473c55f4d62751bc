"""WARC archives with a two-level capture index.

Writing: one gzip member per record, rolled files named by task attempt, so that a task that
runs again never changes a file whose captures were already committed. Index: captures are
range-partitioned and sorted by reversed-host URL key (then id, so that a key with a third of
all captures spreads); each part packs its lines into compressed blocks, and a directory keeps
one row per block. Looking up: keys are routed to parts by the parts' bounds (one row per
partition of the index job), found in the part's directory by binary search, the block is
fetched by a range read, and its lines are searched the same way. Captures are then read in
the order of file and offset, again by range.

Files are reached through ``pyarrow.fs`` by URI and live in the shared folder.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.rows import pieces_of
from isochord.session import scratch_path, written

LINES_PER_BLOCK = 1000
FILE_BYTES = 1 << 30
SLICE_BYTES = 4 << 20
#: Bytes of archives that one task reads back.
FETCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("key string, id long, type string, digest string, payload_bytes long, "
           "file string, offset long, length long")
RECORD = ("id long, url string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to long, payload binary")


def url_key(url: str | None) -> str:
    """The host's labels reversed and joined by commas, then the rest of the URL.

    Scheme, user and default port are left out. NULL is the empty key; what has no host keeps
    its text behind a bracket.
    """
    if url is None:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        host, port = "", None
    if not host:
        return ")" + url
    rest = (u.path or "/") + ("?" + u.query if u.query else "")
    number = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(reversed(host.split("."))) + number + ")" + rest


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unheader(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(id_: int | None, url: str | None, payload: bytes, refers_to: int | None,
                 revisit: bool, date: str) -> bytes:
    """One record, uncompressed. A revisit holds the HTTP head only, with the full length."""
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:capture:{'' if id_ is None else id_}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}",
                  f"WARC-Refers-To: <urn:capture:{'' if refers_to is None else refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of RECORD from one uncompressed record; the payload's digest is taken anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n")
                  if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (payload_digest(payload) != digest or len(payload) != length):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(name):
        text = fields.get(name, "<urn:capture:>").removeprefix("<urn:capture:").removesuffix(">")
        return int(text) if text else None
    url = fields.get("WARC-Target-URI")
    return {"id": number("WARC-Record-ID"), "url": None if url is None else _unheader(url),
            "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest,
            "refers_to": number("WARC-Refers-To") if revisit else None,
            "payload": None if revisit else payload}


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():05d}-{task.taskAttemptId()}"


def _writer(folder: str, date: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        out, name, at, turn = None, "", 0, 0
        try:
            for batch in batches:
                for part in pieces_of(batch, "html", SLICE_BYTES):
                    rows = []
                    for r in part.to_pylist():
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            name, at, turn = f"{_attempt()}-{turn:04d}.warc.gz", 0, turn + 1
                            out = store.open_output_stream(f"{path}/{name}", compression=None)
                        payload = (r["html"] or "").encode()
                        data = gzip.compress(record_bytes(
                            r["id"], r["url"], payload, r["first"], r["revisit"], date), 6, mtime=0)
                        out.write(data)
                        rows.append({"key": url_key(r["url"]), "id": r["id"],
                                     "type": "revisit" if r["revisit"] else "response",
                                     "digest": payload_digest(payload),
                                     "payload_bytes": len(payload), "file": name, "offset": at,
                                     "length": len(data)})
                        at += len(data)
                    yield pa.RecordBatch.from_pylist(rows, CAPTURES)
        finally:
            if out is not None:
                out.close()
    return write


CAPTURES = pa.schema([("key", pa.string()), ("id", pa.int64()), ("type", pa.string()),
                      ("digest", pa.string()), ("payload_bytes", pa.int64()),
                      ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", date: str = "2024-01-01T00:00:00Z",
                   min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record per page below ``folder``; returns its captures (CAPTURE) as a table.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the smallest id are
    responses and the others revisits of that id; smaller payloads are all responses. Pages that
    repeat with the smallest id are all responses; NULL ids come last, and where a payload has no
    other they are all responses. A NULL payload is empty; a NULL URL has the empty key.
    """
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    flat = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("html"))
    sha = F.sha1(F.encode("html", "UTF-8"))
    big = F.octet_length("html") >= min_bytes
    # payloads seen once are no revisits: only the others travel
    firsts = written(flat.filter(big).select("id", sha.alias("sha")).groupBy("sha")
                     .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("sha", "first"), "firsts")
    rows = (flat.withColumn("of", F.when(big, sha))
            .join(firsts, F.col("of") == F.col("sha"), "left")
            .select("id", "url", "html", "first",
                    (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
                    .alias("revisit")))
    return written(rows.mapInArrow(_writer(folder, date, file_bytes), CAPTURE), "captures")


def _packer(folder: str, lines_per_block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        part, name, held, at = TaskContext.get().partitionId(), f"{_attempt()}.idx", [], 0
        out = None

        def flush():
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("\n".join(json.dumps(x, separators=(",", ":"))
                                           for x in held).encode())
            out.write(data)
            row = {"part": part, "first_key": held[0][0], "last_key": held[-1][0], "index": name,
                   "at": at, "size": len(data)}
            at += len(data)
            held.clear()
            return pa.RecordBatch.from_pylist([row], DIRECTORY)
        for batch in batches:
            for r in batch.to_pylist():
                held.append([r[c] for c in CAPTURES.names])
                if len(held) >= lines_per_block:
                    yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()
    return pack


DIRECTORY = pa.schema([("part", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()),
                       ("index", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def build_index(captures: DataFrame, folder: str, lines_per_block: int = LINES_PER_BLOCK
                ) -> DataFrame:
    """Sorts captures into compressed blocks below ``folder``; returns the directory as a table
    (part, first_key, last_key, index, at, size), one row per block."""
    ordered = (captures.repartitionByRange("key", "id", "file", "offset")
               .sortWithinPartitions("key", "id", "file", "offset"))
    return written(ordered.mapInArrow(
        _packer(folder, lines_per_block), "part int, first_key string, last_key string, "
        "index string, at long, size long"), "directory")


class BlockReader:
    """Blocks of one part by range reads; keeps the last one."""

    def __init__(self, folder: str):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.files: dict[str, pa.NativeFile] = {}
        self.last: tuple[tuple, list] | None = None

    def read(self, index: str, at: int, size: int) -> list:
        if self.last is None or self.last[0] != (index, at):
            if index not in self.files:
                self.files[index] = self.store.open_input_file(f"{self.path}/{index}")
            data = zlib.decompress(self.files[index].read_at(size, at))
            self.last = ((index, at), [json.loads(x) for x in data.decode().split("\n")])
        return self.last[1]


def _looker(folder: str):
    def look(queries: pa.Table, directory: pa.Table) -> pa.Table:
        rows = sorted(directory.to_pylist(), key=lambda r: (r["index"], r["at"]))
        # strings order as in Spark: by their UTF-8 bytes
        lasts = [r["last_key"].encode() for r in rows]
        reader, found = BlockReader(folder), []
        for key in sorted(queries.column("key").to_pylist(), key=str.encode):
            b = bisect.bisect_left(lasts, key.encode())
            while b < len(rows) and rows[b]["first_key"].encode() <= key.encode():
                lines = reader.read(rows[b]["index"], rows[b]["at"], rows[b]["size"])
                i = bisect.bisect_left(lines, key.encode(), key=lambda x: x[0].encode())
                while i < len(lines) and lines[i][0] == key:
                    found.append(lines[i])
                    i += 1
                b += 1
        columns = list(zip(*found)) if found else [[] for _ in CAPTURES]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CAPTURES)],
                                    schema=CAPTURES)
    return look


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Captures (CAPTURE) of the distinct, non-NULL ``key`` values; unknown keys give none."""
    parts = (directory.groupBy("part").agg(F.min("first_key").alias("lo"),
                                           F.max("last_key").alias("hi")).collect())
    parts = sorted(parts, key=lambda r: r.part)
    numbers, lows, highs = ([r[c] for r in parts] for c in ("part", "lo", "hi"))
    lows, highs = [x.encode() for x in lows], [x.encode() for x in highs]

    @F.arrow_udf("array<int>")
    def route(key: pa.Array) -> pa.Array:
        coded = [k.encode() for k in key.to_pylist()]
        return pa.array([numbers[bisect.bisect_left(highs, k):bisect.bisect_right(lows, k)]
                         for k in coded], pa.list_(pa.int32()))
    asked = keys.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL")
    routed = asked.distinct().select("key", F.explode(route("key")).alias("part"))
    return (routed.groupBy("part").cogroup(directory.groupBy("part"))
            .applyInArrow(_looker(folder), CAPTURE))


def _fetcher(folder: str, with_payload: bool):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary())])
        name, file = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).select(["file", "offset", "length"]).to_pylist():
                    if r["file"] != name:
                        if file is not None:
                            file.close()
                        name, file = r["file"], store.open_input_file(f"{path}/{r['file']}")
                    record = parse_record(gzip.decompress(file.read_at(r["length"], r["offset"])))
                    rows.append(record if with_payload else record | {"payload": None})
                yield pa.RecordBatch.from_pylist(rows, schema)
    return fetch


def fetch(captures: DataFrame, folder: str, with_payload: bool = True,
          part_bytes: int = FETCH_BYTES) -> DataFrame:
    """The records (RECORD) of captures, by range reads in the order of file and offset.

    A task reads about ``part_bytes`` of archives: their number follows from the lengths of the
    records, not from the much shorter lines that name them. The payload of a response is checked
    against its digest; that of a revisit is NULL.
    """
    lines = written(captures.select("file", "offset", "length"), "found")
    parts = max(1, -(-(lines.agg(F.sum("length")).first()[0] or 0) // part_bytes))
    ordered = (lines.repartitionByRange(parts, "file", "offset")
               .sortWithinPartitions("file", "offset"))
    return ordered.mapInArrow(_fetcher(folder, with_payload), RECORD)


def archive_round_trip(pages: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """Writes pages into new archives, indexes them, and reads every URL key back."""
    folder = scratch_path(spark, "warc")
    captures = write_archives(pages, folder, **options)
    directory = build_index(captures, folder)
    return fetch(lookup(captures.select("key"), directory, folder), folder, with_payload=False)
