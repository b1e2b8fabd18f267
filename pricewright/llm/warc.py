"""WARC archives with revisit resolution.

1. One pass over the pages packs their payloads into blocks of files in the
   shared folder and gives a header for each: key, address, digest, size and the
   payload's place.
2. The headers alone are shuffled, by digest: the first record of a payload of
   ``min_bytes`` or more is its response, the others are revisits that refer to
   it.  Digests that hold more than a thousandth of all rows, fewer than a
   thousand by that, are broadcast instead.
3. The verdicts go back to the blocks, each of which one task reads and writes
   into archives with fresh headers: a gzip member a record, an information
   record first, files of a bounded size.
4. The archives are read back by stretches of members.

A null payload is empty.  Smaller payloads are all responses.  Rows that repeat
the smallest key of a payload are responses, too, each with a record id of its
own; rows with a null key never are the original if another key exists.  Long
payloads are read and written as a whole.  Other columns are not looked at,
whatever their names.  An empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.shared import by_bytes, byte_texts, joined_by_key, remove_folder, scratch, session_of, shared_folder, written

MIN_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a file is closed, bytes that one task reads at a time, and bytes of payloads packed in one block.
FILE_BYTES, STRETCH_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20, 4 << 20
#: Unpacked bytes after which a stretch is closed, too: repetitive pages pack to a thousandth.
UNPACKED_BYTES = 64 << 20
#: Bytes that are unpacked at a time.
PIECE = 8192

HEADERS = "key long, url string, digest string, size long, file string, offset long, bytes long, at int"


def packed(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Put the payloads into blocks of files; a header per row, with the payload's place.

    A task that runs again writes a file of another name, which no header names.
    """
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name, offset, out = f"payloads-{uuid.uuid4().hex}", 0, None
        for batch in batches:
            for part in by_bytes(batch, 2, BLOCK_BYTES):
                payloads = byte_texts(part.column(2))
                sink = pa.BufferOutputStream()
                block = pa.RecordBatch.from_arrays([pa.array(payloads, pa.large_binary())], names=["payload"])
                with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(block)
                data, n = sink.getvalue(), part.num_rows
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                digests = [hashlib.sha256(x).hexdigest() for x in payloads]
                places = [pa.array([name] * n, pa.string()), pa.array([offset] * n, pa.int64()), pa.array([data.size] * n, pa.int64()), pa.array(range(n), pa.int32())]
                columns = [part.column(0), part.column(1).cast(pa.string()), pa.array(digests, pa.string()), pa.array(map(len, payloads), pa.int64()), *places]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in HEADERS.split(", ")])
                offset += data.size
        if out is not None:
            out.close()

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    return written(rows.mapInArrow(pack, HEADERS), "warc-headers")


def resolved(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The headers with record_type and, for revisits, key, address and place of their response."""
    large, total = headers.where(F.col("size") >= min_bytes), headers.count()
    # Small payloads are all responses; they meet in few digests, so they stay out of the join.
    small = headers.where(F.col("size") < min_bytes)
    first = large.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("key").isNull(), "key", "url", "file", "offset", "at")).alias("first")).where("n > 1")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key"))
    first = written(first, "warc-first")
    rows = joined_by_key(large, first, "digest", total)
    none = dict(first.dtypes)
    rows = rows.unionByName(small.withColumns({c: F.lit(None).cast(none[c]) for c in ("n", "first")}))
    return rows.select(
        *headers.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.key")).alias("refers_to"),
        F.when(again, F.col("first.url")).alias("refers_to_url"), F.when(again, F.concat_ws("/", "first.file", "first.offset", "first.at")).alias("refers_to_place"),
    )


def record_id(run: str, place: str) -> str:
    """A record's id: one for each place of a payload and run, so that revisits can name it before it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), place)}>"


def lines_of(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda x: str(x).replace("\r", "%0D").replace("\n", "%0A")
    return "\r\n".join(["WARC/1.1", *(f"{name}: {clean(x)}" for name, x in fields if x is not None)]).encode() + b"\r\n\r\n"


def information(date: str, name: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: pricewright\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return lines_of(fields) + block + b"\r\n\r\n"


def record(row: dict, payload: bytes, run: str, date: str) -> bytes:
    """One record with fresh headers; a revisit keeps the length of the payload it leaves out."""
    revisit = row["record_type"] == "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(run, f"{row['file']}/{row['offset']}/{row['at']}")), ("WARC-Date", date),
        ("WARC-Target-URI", row["url"]), ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Page-ID", row["key"]),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(run, row["refers_to_place"])), ("WARC-Refers-To-Target-URI", row["refers_to_url"]), ("Refers-To-Page-ID", row["refers_to"])]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return lines_of(fields) + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Headers of a record (lower-case names), its block in ``block`` and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found: dict = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
    n = int(found["content-length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a record's length does not match")
    found["block"] = rest[:n]
    found["payload"] = found["block"].partition(b"\r\n\r\n")[2]
    return found


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a stretch, unpacked, in time that grows with its length."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            piece = view[at : at + PIECE]
            if not piece:
                raise ValueError("a record is cut short")
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(parts)


MANIFEST = "file string, offset long, bytes long, records int"


def write_archives(rows: DataFrame, payloads: str, folder: str, date: str | None = None) -> DataFrame:
    """Write resolved headers with their payloads; returns the stretches of the files that stand.

    Only headers are shuffled, to bring those of a block together.  A task that
    runs again writes files of other names, so half-written ones are in no
    manifest.
    """
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    run, date = str(uuid.uuid4()), date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, size, begin, n, unpacked = None, "", 0, 0, 0, 0
        stretches: list[tuple] = []
        block, body = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if block != (row["file"], row["offset"]):
                    block = (row["file"], row["offset"])
                    source, base = pafs.FileSystem.from_uri(payloads)
                    with source.open_input_file(f"{base}/{row['file']}") as f:
                        f.seek(row["offset"])
                        body = pa.ipc.open_stream(f.read(row["bytes"])).read_all()["payload"].chunk(0)
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    size, begin, n = out.write(gzip.compress(information(date, name), 5, mtime=0)), 0, 1
                whole = record(row, body[row["at"]].as_py(), run, date)
                size += out.write(gzip.compress(whole, 5, mtime=0))
                n, unpacked = n + 1, unpacked + len(whole)
                if size - begin >= STRETCH_BYTES or unpacked >= UNPACKED_BYTES:
                    stretches.append((name, begin, size - begin, n))
                    begin, n, unpacked = size, 0, 0
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        if out is not None:
            out.close()
            if n:
                stretches.append((name, begin, size - begin, n))
        columns = list(zip(*stretches, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "at")
    return written(dealt.mapInArrow(write, MANIFEST), "warc-manifest", keep=True)


RECORD = "record_id string, key long, url string, record_type string, digest string, size long, refers_to long, refers_to_id string"


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of a page; digest and size of responses are taken from their payloads."""

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def facts(x: dict) -> tuple:
        digest, size = x["warc-payload-digest"].removeprefix("sha256:"), int(x["block"].partition(b"Content-Length: ")[2].partition(b"\r\n")[0])
        if x["warc-type"] == "response" and (digest, size) != (hashlib.sha256(x["payload"]).hexdigest(), len(x["payload"])):
            raise ValueError("a payload does not match its record")
        return (x["warc-record-id"], number(x.get("page-id")), x.get("warc-target-uri"), x["warc-type"], digest, size, number(x.get("refers-to-page-id")), x.get("warc-refers-to"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for stretch in batch.to_pylist():
                with store.open_input_file(f"{root}/{stretch['file']}") as f:
                    f.seek(stretch["offset"])
                    data = f.read(stretch["bytes"])
                # One record at a time is unpacked, and only its facts are kept.
                found = [None if x["warc-type"] == "warcinfo" else facts(x) for x in map(parsed, members(data))]
                if len(found) != stretch["records"]:
                    raise ValueError(f"{stretch['file']} lacks records")
                columns = list(zip(*(x for x in found if x is not None), strict=True)) or [()] * 8
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, RECORD)


def written_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the archives of a table in the shared folder and read them back."""
    spark = session_of(pages)
    folder, payloads = shared_folder(spark, "warc"), shared_folder(spark, "warc-payloads")
    with scratch(spark):
        manifest = write_archives(resolved(packed(pages, payloads, key, url, payload)), payloads, folder)
    remove_folder(spark, payloads)
    return read_archives(spark, manifest, folder)


def report(pages: DataFrame) -> DataFrame:
    rows = written_and_read(pages)
    return rows.select(F.col("key").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""
