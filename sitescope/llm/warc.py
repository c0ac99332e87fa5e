"""WARC archives with a two-level capture index.

``write_archives`` writes one record per page into gzip members of WARC files; equal payloads are stored once, by the
capture with the largest id, and others revisit it. ``build_index`` sorts the captures by their reversed-host key, cuts the
sorted lines into blocks that are compressed one by one, and keeps a sparse directory with each block's first key and
place. ``lookup`` finds the file of an index shard by its first key, binary-searches the shard's directory, reads the one
block by its byte range, and binary-searches in the block. ``fetch`` reads the records' byte ranges, in file order.

Tasks write to the shared folder. File names are unique to an attempt and only rows of finished tasks name them, so lost
executors and repeated attempts leave at most files that nobody reads.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, sliced, table
from .files import new_name, open_store

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 512
#: Captures in an index shard, and bytes of records that one task reads back.
SHARD_CAPTURES, FETCH_BYTES = 1_000_000, 128 << 20
#: Payloads that more than one in so many pages has are fewer than that: their decisions are broadcast.
HOT = 1000
#: Ranges of one file that are nearer than this are read at once.
READ_AHEAD = 1 << 16


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased: ``com,example,www)/a?b``. Null: the empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    return (host + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record, uncompressed. A revisit holds the HTTP header, with the payload's length, and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {page_id}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and content of one uncompressed record; the digest of a stored payload is computed anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"record of page {fields['WARC-Page-ID']} is damaged")
    return {"page_id": fields["WARC-Page-ID"], "kind": kind, "digest": digest, "bytes": size, "refers_to": fields.get("WARC-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the largest page_id with the same payload, null for itself.

    Payloads of fewer than ``min_bytes`` are never revisited. Null page_ids cannot be referred to: such rows are responses
    unless another page has their payload. Frequent payloads (more than one in HOT pages; fewer than HOT) are decided from a
    broadcast, and only the others meet by digest.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    same = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    same = table(same.where("n > 1 AND keeper IS NOT NULL"), "warc-equal")
    floor = max(2, pages.count() // HOT + 1)  # fewer than HOT payloads can have so many pages
    hot = same.where(F.col("n") >= floor).select(F.col("digest").alias("hot_digest"), F.col("keeper").alias("hot_keeper"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    spread = F.when(F.col("hot_keeper").isNull(), F.coalesce("digest", F.encode(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "UTF-8")))
    rows = rows.withColumn("meet", F.coalesce(spread, F.encode(F.concat(F.lit("page:"), F.col("page_id").cast("string")), "UTF-8"), F.encode(F.lit("null"), "UTF-8")))
    rows = rows.join(same.where(F.col("n") < floor).select(F.col("digest").alias("meet"), "keeper"), "meet", "left")
    keeper = F.coalesce("hot_keeper", "keeper")
    return rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(keeper), keeper).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives below ``folder``; returns one row per capture: key, page_id, file, at, size."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        out, name, at = None, new_name("pages", "warc.gz"), 0
        try:
            for b in batches:
                keys, places, sizes = [], [], []
                for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(page, url, payload, refers)) + packer.flush()
                    out.write(data)
                    keys.append(url_key(url))
                    places.append(at)
                    sizes.append(len(data))
                    at += len(data)
                arrays = [pa.array(keys, pa.string()), b.column(0), pa.array([name] * len(keys), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "page_id", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    rows = decide(pages, min_bytes)
    return table(rows.mapInArrow(run, f"key string, page_id {kind}, file string, at long, size long"), "warc-captures")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, shards: int | None = None) -> DataFrame:
    """Sorts the captures into index shards; returns one row per shard: first (key), shard, directory, lines.

    A shard is two files: blocks, each a zlib stream of ``block_lines`` sorted lines, and the directory, one line for each
    block with its first key, offset and length.
    """
    n = shards or max(captures.sparkSession.sparkContext.defaultParallelism, -(-captures.count() // SHARD_CAPTURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        blocks, directory, held, at, first, total, out = new_name("index", "blocks"), [], [], 0, None, 0, None

        def close() -> None:
            nonlocal at, held
            data = zlib.compress("\n".join(held).encode())
            out.write(data)
            directory.append(f"{held[0].split('\t')[0]}\t{at}\t{len(data)}")
            at, held = at + len(data), []

        try:
            for b in batches:
                for line in b.column(0).to_pylist():
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out, first = store.open_output_stream(f"{path}/{blocks}", compression=None), line.split("\t")[0]
                    held.append(line)
                    total += 1
                    if len(held) == block_lines:
                        close()
            if held:
                close()
        finally:
            if out is not None:
                out.close()
        if out is not None:
            name = new_name("index", "directory")
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([blocks]), pa.array([name]), pa.array([total], pa.int64())], ["first", "shard", "directory", "lines"])

    line = F.concat_ws("\t", sort_key(), F.col("file"), F.col("at"), F.col("size")).alias("line")
    rows = captures.select(line).repartitionByRange(n, "line").sortWithinPartitions("line")
    return table(rows.mapInArrow(run, "first string, shard string, directory string, lines long"), "warc-index")


def sort_key():
    """The index key of a capture: the URL's key without tabs and line ends, a space, and the padded page id."""
    key = F.translate(F.col("key"), "\t\n\r", "   ")
    number = F.lpad((F.col("page_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(key, F.lit(" "), F.coalesce(number, F.lit("")))


def lookup(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """(file, at, size) of every capture in ``wanted`` (key, page_id), through the two levels of the index.

    One row per index shard is collected (their number is a parameter of the index). A task's wanted keys come sorted, so
    each block is read once and one directory is in memory at a time.
    """
    shards = sorted((r["first"].encode(), r["shard"], r["directory"]) for r in index.collect())
    firsts = [s[0] for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        shard, block, directory, blocks, lines, keys = -1, -1, [], None, [], []

        def matches(own: bytes) -> Iterator[list[bytes]]:
            nonlocal shard, block, directory, blocks, lines, keys
            # captures with one key may begin before a shard's or a block's first key
            for s in range(max(0, bisect.bisect_left(firsts, own) - 1), bisect.bisect_right(firsts, own)):
                if s != shard:
                    shard, block = s, -1
                    with store.open_input_stream(f"{path}/{shards[s][2]}", compression=None) as f:
                        directory = [(k, int(o), int(n)) for k, o, n in (x.split(b"\t") for x in f.read().split(b"\n"))]
                    blocks = store.open_input_file(f"{path}/{shards[s][1]}")
                begin = max(0, bisect.bisect_left(directory, own, key=lambda d: d[0]) - 1)
                for at in range(begin, bisect.bisect_right(directory, own, key=lambda d: d[0])):
                    if at != block:
                        block = at
                        lines = [x.split(b"\t") for x in zlib.decompress(blocks.read_at(directory[at][2], directory[at][1])).split(b"\n")]
                        keys = [x[0] for x in lines]
                    yield from lines[bisect.bisect_left(keys, own) : bisect.bisect_right(keys, own)]

        for b in batches:
            found = [x for key in b.column(0).to_pylist() for x in matches(key.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([x[1].decode() for x in found], pa.string()), *[pa.array([int(x[k]) for x in found], pa.int64()) for k in (2, 3)]], ["file", "at", "size"])

    keys = wanted.select(sort_key().alias("k")).distinct()
    keys = keys.repartitionByRange(max(1, len(shards)), "k").sortWithinPartitions("k")
    return keys.mapInArrow(run, "file string, at long, size long")


def fetch(places: DataFrame, folder: str, kind: str = "bigint", payloads: bool = False, size: int = 0) -> DataFrame:
    """Reads and checks the records at (file, at, size), each file from front to back, near ranges in one read.

    ``size``: bytes of all records; a task reads FETCH_BYTES of them or less, and holds few records at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        name, source = None, None
        for b in sliced(batches):
            files, at, size = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            rows, i = [], 0
            while i < len(files):
                j = i + 1
                while j < len(files) and files[j] == files[i] and at[j] - at[j - 1] - size[j - 1] < READ_AHEAD and at[j] + size[j] - at[i] < 1 << 22:
                    j += 1
                if files[i] != name:
                    name = files[i]
                    source = store.open_input_file(f"{path}/{name}")
                data = source.read_at(int(at[j - 1] + size[j - 1] - at[i]), int(at[i]))
                for k in range(i, j):
                    own = int(at[k] - at[i])
                    rows.append(parse(zlib.decompress(data[own : own + int(size[k])], 31)))
                i = j
            get = lambda k, t: pa.array([r[k] for r in rows], t)  # noqa: E731,B023
            cols = [get("page_id", pa.string()), get("bytes", pa.int64()), get("digest", pa.string()), get("kind", pa.string()), get("refers_to", pa.string())]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            if payloads:
                cols, names = [*cols, get("payload", pa.binary())], [*names, "payload"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    n = max(places.sparkSession.sparkContext.defaultParallelism, -(-size // FETCH_BYTES))
    rows = places.repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at").mapInArrow(run, schema)
    number = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(kind).alias(c)
    return rows.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), *(["payload"] if payloads else []))


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives and their index, and reads every page back through the index.

    Null html is an empty payload; null or odd URLs have keys like any other; rows that repeat a page_id give a record each.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    captures = write_archives(pages, folder, min_bytes)
    index = build_index(captures, folder)
    found = lookup(index, folder, captures.select("key", "page_id"))
    size = captures.agg(F.sum("size")).first()[0] or 0
    return fetch(found, folder, pages.schema["page_id"].dataType.simpleString(), size=size)
