"""WARC archives with a two-level capture index.

Archives are written by Spark's text writer, so its commit protocol covers lost tasks: a
record ends in CR LF CR LF, whose last byte is the line separator.  Of pages with equal
payloads one is a response record and the others are revisit records without payload.

The index has a line per capture: key, file, offset, length.  Keys are reversed-host URLs
followed by the capture's number.  Lines are range-sorted and packed into compressed
blocks; a sparse directory keeps the first key of every block.  A lookup bisects the
directory, then the one or two blocks it needs, and then reads exactly the bytes of its
record.  Blocks grow with the number of captures, so the directory never has more than
``DIRECTORY`` entries and may be broadcast.

Cases: null html is an empty payload; null urls and ids are written as "-" and read as
null; a payload whose pages all lack an id is a response each time; repeated rows are
records of their own and are all read back; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logdistill.llm.common import empty, new_path, small_side, stage

REVISIT_BYTES = 100
RECORDS_PER_FILE = 4_000
BLOCK_LINES = 1_000
DIRECTORY = 100_000
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def safe_uri(url: str | None) -> str:
    """The url as a header value: control characters and spaces escaped."""
    if url is None:
        return "-"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url)


def reversed_host(uri: str) -> str:
    """``http://Blog.Example.com/a?b`` becomes ``com,example,blog)/a?b``."""
    try:
        parts = urlsplit(uri)
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return uri
    if not host:
        return uri
    tail = parts.path or "/"
    tail += f"?{parts.query}" if parts.query else ""
    tail += f"#{parts.fragment}" if parts.fragment else ""
    return f"{','.join(reversed(host.split('.')))}{port}){tail}"


def capture_key(uri: str, number: str) -> bytes:
    return f"{reversed_host(uri)} {number.rjust(20, '0')}".encode("utf-8", "surrogatepass")


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record without its very last byte, the line feed that the writer adds."""
    uri = safe_uri(url)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {uri} {digest}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {page}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    lines = "\r\n".join(head).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + END + block + END[:3]


def parse_head(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Headers of the record at a place, and where its block and the record end begin."""
    if not data.startswith(VERSION, at):
        raise ValueError(f"no record at byte {at}")
    stop = data.index(END, at)
    lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    head = dict(line.split(": ", 1) for line in lines)
    begin = stop + len(END)
    return head, begin, begin + int(head["Content-Length"])


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to files under ``path``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    facts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"),
    )
    first = (
        facts.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(F.col("digest").alias("d"), "first")
    )
    first = stage(first, "equal-payloads")
    typed = facts.join(small_side(first), F.col("digest") == F.col("d"), "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(
                batch["page_id"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"], strict=True
            )
            yield pd.DataFrame({"record": [record(p or "-", u, h, d, r) for p, u, h, d, r in rows]})

    texts = typed.select(
        F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string")
    )
    # The bytes pass through a string column unchanged.
    texts.mapInPandas(pack, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\n"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, offset, length) of every record in the archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows, at = [], 0
                while at < len(data):
                    head, _, end = parse_head(data, at)
                    stop = end + len(END)
                    rows.append((capture_key(head["WARC-Target-URI"], head["X-Page-ID"]), name, at, stop - at))
                    at = stop
                yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    return files.select("path", "content").mapInPandas(scan, "key binary, file string, offset long, length long")


def build_index(spark: SparkSession, path: str, lines: int = BLOCK_LINES) -> tuple[DataFrame, list[tuple[bytes, int]]]:
    """The blocks (block, first, data), and the directory: first key and number of each."""
    found = stage(captures(spark, path), "captures")
    n = found.count()
    per_block = max(lines, -(-n // DIRECTORY))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_block)))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pd.DataFrame:
            text = b"\n".join(b"\t".join((k, f.encode(), b"%d" % o, b"%d" % s)) for k, f, o, s in rows)
            return pd.DataFrame({"first": [rows[0][0]], "data": [zlib.compress(text)]})

        for batch in batches:
            held += list(batch.itertuples(index=False, name=None))
            while len(held) >= per_block:
                yield out(held[:per_block])
                held = held[per_block:]
        if held:
            yield out(held)

    blocks = (
        found.repartitionByRange(parts, "key", "file", "offset")
        .sortWithinPartitions("key", "file", "offset")
        .select("key", "file", "offset", "length")
        .mapInPandas(packed, "first binary, data binary")
        .withColumn("block", F.monotonically_increasing_id())
    )
    blocks = stage(blocks, "index-blocks")
    # At most DIRECTORY entries and one per partition.
    directory = [(bytes(r["first"]), r["block"]) for r in blocks.select("first", "block").collect()]
    return blocks, sorted(directory)


def lookup(keys: DataFrame, blocks: DataFrame, directory: list[tuple[bytes, int]]) -> DataFrame:
    """(key, file, offset, length) of all captures with one of the distinct ``keys``."""
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(directory)

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts = [f for f, _ in shared.value]
        for batch in batches:
            out = []
            for key in map(bytes, batch["key"]):
                # Equal keys may begin in the block before the first one that starts with them.
                low = max(bisect.bisect_left(firsts, key) - 1, 0)
                out += [(key, shared.value[i][1]) for i in range(low, bisect.bisect_right(firsts, key))]
            yield pd.DataFrame(out, columns=["key", "block"])

    def search(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(wanted):
            rows = [line.rsplit(b"\t", 3) for line in zlib.decompress(block["data"].iloc[0]).split(b"\n")]
            names = [r[0] for r in rows]
            for key in map(bytes, wanted["key"]):
                i = bisect.bisect_left(names, key)
                while i < len(names) and names[i] == key:
                    out.append((key, rows[i][1].decode(), int(rows[i][2]), int(rows[i][3])))
                    i += 1
        return pd.DataFrame(out, columns=["key", "file", "offset", "length"]).astype(
            {"offset": "int64", "length": "int64"}
        )

    placed = stage(keys.mapInPandas(descend, "key binary, block long"), "placed-keys")
    return (
        blocks.select("block", "data").groupBy("block")
        .cogroup(placed.groupBy("block"))
        .applyInPandas(search, "key binary, file string, offset long, length long")
    )


def read_ranges(places: DataFrame) -> DataFrame:
    """Read exactly the bytes of each place (file, offset, length), and parse the record."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        name, handle = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                if file != name:
                    if handle is not None:
                        handle.close()
                    uri = f"file://{file[5:]}" if file.startswith("file:/") and not file.startswith("file://") else file
                    system, inside = fs.FileSystem.from_uri(uri)
                    name, handle = file, system.open_input_file(inside)
                data = handle.read_at(int(length), int(offset))
                head, begin, end = parse_head(data)
                block = data[begin:end]
                payload = block[block.index(END) + len(END) :]
                kind = head["WARC-Type"]
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"damaged payload in {file} at {offset}")
                size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                page = head["X-Page-ID"]
                out.append(
                    (None if page == "-" else page, head["WARC-Target-URI"], payload, size, digest, kind, head.get("X-Refers-To-Page"))
                )
            yield pd.DataFrame(
                out, columns=["page_id", "uri", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )
        if handle is not None:
            handle.close()

    return (
        places.repartition("file")
        .sortWithinPartitions("file", "offset")
        .select("file", "offset", "length")
        .mapInPandas(
            read,
            "page_id string, uri string, payload binary, payload_bytes long, payload_digest string, "
            "record_type string, refers_to string",
        )
        .withColumn("page_id", F.col("page_id").cast("long"))
        .withColumn("refers_to", F.col("refers_to").cast("long"))
    )


def capture_keys(pages: DataFrame) -> DataFrame:
    """The distinct index keys of pages."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["page"], batch["url"], strict=True)
            yield pd.DataFrame({"key": [capture_key(safe_uri(u), p) for p, u in rows]})

    page: Column = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("-"))
    return pages.select(page.alias("page"), "url").mapInPandas(keys, "key binary").distinct()


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, index the archives, look every page up and read its record."""
    spark = pages.sparkSession
    narrow = pages.select("page_id", "url", "html")
    path = new_path(spark, "archives")
    write_archives(narrow, path)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if narrow.isEmpty():
        return empty(
            spark, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    blocks, directory = build_index(spark, path)
    places = stage(lookup(capture_keys(narrow), blocks, directory), "places")
    return read_ranges(places).select(*names)


ORACLE = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT payload_digest, payload_bytes, min(page_id) AS first FROM p WHERE payload_bytes >= 100
  GROUP BY payload_digest, payload_bytes)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest, payload_bytes)
"""
