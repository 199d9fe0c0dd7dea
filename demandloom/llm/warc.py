"""WARC archives: whole-file gzip in, one gzip member for each record out, with a sidecar offset index.

Archives are written by Spark's text writer, which makes one gzip stream of each file. The normaliser
inflates such a stream once, piece by piece, writes every record as a member of its own and notes
where it begins, so that single records can be read by offset.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import scratch_path, sized, staged

#: Records of equal payload that are at least this long are stored once.
MIN_REVISIT_BYTES = 0
RECORDS_PER_FILE = 20_000
MEMBER_LEVEL = 4
#: Rows of the index that are held before they are passed on.
INDEX_ROWS = 10_000
#: Pages carry no time of capture; WARC asks for one.
CAPTURED = "1970-01-01T00:00:00Z"
_PIECE = 1 << 20
INDEX_SCHEMA = "file string, offset long, length long, record_id string, record_type string"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base 32 of a hexadecimal string of 40 digits, five bytes at a time."""
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """`(key, url, payload, bytes, digest, record_type, refers_to)` of every page; null html is empty.

    Of pages with equal payloads the one of the smallest key is the response, and the others revisit
    it. Payloads are equal if SHA-256 and length are. The smallest keys are combined before the
    shuffle; only payloads that occur twice are joined back.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    hashed = pages.select(
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload.cast("binary"), 256).alias("same"),
    )
    firsts = staged(
        hashed.where(F.col("bytes") >= min_bytes)
        .groupBy("same", "bytes")
        .agg(F.min("key").alias("first"), F.count("*").alias("times"))
        .where("times > 1")
        .select("same", "bytes", "first"),
        "payloads",
    )
    found = hashed.join(sized(firsts, 120), ["same", "bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return found.select(
        "key",
        "url",
        "payload",
        "bytes",
        base32_of_hex(F.sha1(F.col("payload").cast("binary"))).alias("digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record_text(page: DataFrame) -> Column:
    """One WARC/1.1 record, without its last line feed, which the text writer adds."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), page["bytes"], F.lit("\r\n\r\n")
    )
    revisit = page["record_type"] == "revisit"
    body = F.concat(http, F.when(revisit, "").otherwise(page["payload"]))

    def name(column: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("")), F.lit(">"))

    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        page["record_type"],
        F.lit("\r\nWARC-Record-ID: "),
        name(page["key"]),
        F.lit(f"\r\nWARC-Date: {CAPTURED}\r\nWARC-Target-URI: "),
        F.translate(F.coalesce(page["url"], F.lit("")), "\r\n", "  "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        page["digest"],
        F.lit("\r\nX-Payload-Length: "),
        page["bytes"],
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                name(page["refers_to"]),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(body),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r"),
    )


def write_archives(found: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """`with_revisits` rows as files of one gzip stream each."""
    found.select(record_text(found).alias("value")).write.option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def _open(uri: str):
    """File system and path of what Spark calls `uri`."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, in pieces of bounded size."""
    inflater = zlib.decompressobj(31)
    fresh = True
    while data := stream.read(_PIECE):
        while data:
            piece = inflater.decompress(data, _PIECE)
            fresh = False
            if piece:
                yield piece
            data = inflater.unconsumed_tail
            if inflater.eof:
                data, inflater, fresh = inflater.unused_data, zlib.decompressobj(31), True
    while not fresh and not inflater.eof:
        piece = inflater.decompress(b"", _PIECE)
        if not piece and not inflater.eof:
            raise EOFError("the gzip stream ends too early")
        if piece:
            yield piece


def head_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins with {lines[0][:40]!r}")
    return {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, Iterator[bytes]]]:
    """Fields, raw head and the pieces of the rest (block and closing line breaks) of each record.

    The rest must be read to its end before the next record; no record is held whole.
    """
    held = bytearray()
    source = iter(chunks)

    def more() -> bool:
        piece = next(source, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise EOFError("the archive ends inside a record")
                return
        head = bytes(held[: stop + 4])
        del held[: stop + 4]
        fields = head_of(head)
        left = int(fields["content-length"]) + 4

        def rest(left: int = left) -> Iterator[bytes]:
            while left:
                if not held and not more():
                    raise EOFError("the archive ends inside a record")
                piece = bytes(held[:left])
                del held[: len(piece)]
                left -= len(piece)
                yield piece

        yield fields, head, rest()


def _normalise_one(uri: str, target: str) -> Iterator[pa.RecordBatch]:
    """Rewrites one file as `<target>/<name>` and `<name>.idx`; both appear whole or not at all.

    Yields the index as it grows, so that no more than a batch of it is held.
    """
    source_fs, source_path = _open(uri)
    fs, folder = _open(target)
    name = re.sub(r"(\.txt)?\.gz$", "", uri.rsplit("/", 1)[-1]) + ".warc.gz"
    task = TaskContext.get()
    attempt = f".{task.taskAttemptId()}.tmp" if task else ".tmp"
    fs.create_dir(folder, recursive=True)
    rows, at = [], 0
    with (
        source_fs.open_input_stream(source_path, compression=None) as stream,
        fs.open_output_stream(f"{folder}/{name}{attempt}", compression=None) as out,
        fs.open_output_stream(f"{folder}/{name}.idx{attempt}", compression=None) as index,
    ):
        for fields, head, rest in records(inflated(stream)):
            packer = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
            length = 0
            for part in chain([head], rest):
                packed = packer.compress(part)
                out.write(packed)
                length += len(packed)
            packed = packer.flush()
            out.write(packed)
            length += len(packed)
            record, kind = fields["warc-record-id"], fields["warc-type"]
            index.write((json.dumps([at, length, record, kind]) + "\n").encode())
            rows.append((f"{target}/{name}", at, length, record, kind))
            at += length
            if len(rows) >= INDEX_ROWS:
                yield _index_batch(rows)
                rows = []
    fs.move(f"{folder}/{name}{attempt}", f"{folder}/{name}")
    fs.move(f"{folder}/{name}.idx{attempt}", f"{folder}/{name}.idx")
    yield _index_batch(rows)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["file", "offset", "length", "record_id", "record_type"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites every gzip file below `source` into `target`; returns the index of all records.

    A file is one task's work and is streamed: memory does not grow with files or records. Each result
    is written under another name and moved into place, so a repeated task replaces it. Truncated or
    malformed archives stop the job with the reason. The index is written once and read back. `target`
    must be reachable by all executors.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    count = files.count()
    # One file to a partition, as evenly as a shuffle of their names can.
    spread = files.repartition(max(1, count), "path") if count else files

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _normalise_one(path, target)

    return staged(spread.mapInArrow(work, INDEX_SCHEMA), "warc-index")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar indexes of normalised archives, as `normalise` returns them."""
    lines = spark.read.text(target, pathGlobFilter="*.idx").select(
        F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", "").alias("file"),
        F.from_json("value", "array<string>").alias("v"),
    )
    return lines.select(
        "file", F.col("v")[0].cast("long").alias("offset"), F.col("v")[1].cast("long").alias("length"),
        F.col("v")[2].alias("record_id"), F.col("v")[3].alias("record_type"),
    )


def read_records(index: DataFrame) -> DataFrame:
    """Reads every indexed record by its offset: ids, type, url, and length and digest of the payload.

    Of responses the payload itself is measured; a revisit carries both in its header.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None
        for batch in batches:
            out: list[tuple] = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if opened is None or opened[0] != file:
                    fs, path = _open(file)
                    opened = (file, fs.open_input_file(path))
                member = zlib.decompress(opened[1].read_at(length, offset), 31)
                head, _, block = member.partition(b"\r\n\r\n")
                fields = head_of(head)
                block = block[: int(fields["content-length"])]
                if fields["warc-type"] == "response":
                    body = block.partition(b"\r\n\r\n")[2]
                    size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                else:
                    size = int(fields["x-payload-length"])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                out.append(
                    (fields["warc-record-id"], fields["warc-type"], fields["warc-target-uri"], size, digest, fields.get("warc-refers-to"))
                )
            kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string()]
            names = ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    return index.select("file", "offset", "length").mapInArrow(
        work, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string"
    )


def page_of(column: str) -> Column:
    """The page's key in a column of record ids; null if it has none."""
    return F.regexp_extract(column, "^<urn:page:(.*)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Writes `pages` as archives, normalises them and reads every record back.

    Below `path` (or the shared folder) `raw` holds whole-file gzip and `members` the normalised files
    with their indexes. Columns: `page_id`, `record_type`, `url`, `payload_bytes`, `payload_digest`,
    `refers_to`. Null html is an empty payload, null urls are empty, null keys stay null, repeated
    rows are records of their own (all of the smallest key are responses). Keys of another type than a
    whole number are refused. An empty table gives no rows.
    """
    spark = pages.sparkSession
    if not isinstance(pages.schema[kw.get("key", "page_id")].dataType, T.IntegralType):
        raise ValueError("keys of pages must be whole numbers")
    path = path or scratch_path(spark, "warc")
    write_archives(with_revisits(pages, **kw), f"{path}/raw")
    index = normalise(spark, f"{path}/raw", f"{path}/members")
    read = read_records(index)
    return read.select(
        page_of("record_id").alias("page_id"),
        "record_type",
        "url",
        "payload_bytes",
        "payload_digest",
        page_of("refers_to").alias("refers_to"),
    )
