"""Bounded-space online packing of token sequences.

Each partition reads its documents once, keeps at most `open_windows` open windows and puts each
piece into the open window that it fills best. When none has room, the fullest is emitted and a new
one opened. Windows still open at the end are merged afterwards, a bounded number to a task: best
fit by whole windows first, then the rest is poured together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import scratch_path
from .tokens import Encoder
from .words import pieces

LENGTH = 1024
OPEN_WINDOWS = 64
END_ID = 0
#: Leftover windows that one task merges.
MERGE_WINDOWS = 4096
_YIELD_BYTES = 4 << 20
_MERGED = 1 << 61


class Windows:
    """Open windows by free room. A piece is (key, start, ids, document's tokens)."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, size: int, content: list) -> list[list]:
        """Puts `content` into the window it fills best; returns the windows that leave."""
        at = bisect_left(self.free, (size, -1))
        out = None
        if at < len(self.free):
            room, name = self.free.pop(at)
            self.held[name].extend(content)
        else:
            if len(self.free) >= self.most:
                _, fullest = self.free.pop(0)
                out = self.held.pop(fullest)
            room, name = self.length, self.made
            self.made += 1
            self.held[name] = list(content)
        if room - size:
            insort(self.free, (room - size, name))
            return [out] if out else []
        full = self.held.pop(name)
        return [w for w in (out, full) if w]

    def rest(self) -> list[list]:
        left = [self.held[name] for _, name in self.free]
        self.free, self.held = [], {}
        return left


class Rows:
    """Piece rows of finished windows, handed out as record batches."""

    def __init__(self, schema: pa.Schema, first_id: int) -> None:
        self.schema, self.next_id = schema, first_id
        self.columns: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, window: list, closed: bool) -> None:
        offset = 0
        for key, start, ids, total in window:
            n = len(ids) // 4
            for column, value in zip(
                self.columns, (key, start, n, ids, total, self.next_id, offset, closed), strict=True
            ):
                column.append(value)
            offset += n
            self.bytes += len(ids) + 64
        self.next_id += 1

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema
        )
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return batch


def _schema(kind: T.DataType) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    names = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType())]
    names += [("sequence_id", T.LongType()), ("offset", T.LongType()), ("closed", T.BooleanType())]
    fields = [T.StructField("key", kind), *(T.StructField(n, t) for n, t in names)]
    return T.StructType(fields), pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])


def _online(docs: DataFrame, key: str, text: str, length: int, most: int, path: str | None) -> DataFrame:
    spark_schema, arrow_schema = _schema(docs.schema[key].dataType)
    end = np.array([END_ID], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = Encoder(path), Windows(length, most)
        rows = Rows(arrow_schema, TaskContext.get().partitionId() << 32)
        for batch in pieces(batches, text):
            keys = batch.column(key).to_pylist()
            for name, ids in zip(keys, encoder.encode(batch.column(text).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total - total % length
                for at in range(0, whole, length):
                    rows.add([(name, at, ids[4 * at : 4 * (at + length)], total)], True)
                if whole < total:
                    for window in windows.place(total - whole, [(name, whole, ids[4 * whole :], total)]):
                        rows.add(window, True)
                if rows.bytes > _YIELD_BYTES:
                    yield rows.take()
        for window in windows.rest():
            rows.add(window, False)
        if rows.bytes:
            yield rows.take()

    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)).mapInArrow(scan, spark_schema)


def pour(contents: list, length: int) -> list[list]:
    """Pieces one after another, cut wherever a window is full."""
    out, window, room = [], [], length
    for key, start, ids, total in contents:
        while ids:
            piece, ids = ids[: 4 * room], ids[4 * room :]
            window.append((key, start, piece, total))
            start += len(piece) // 4
            room -= len(piece) // 4
            if room == 0:
                out.append(window)
                window, room = [], length
    return out + [window] * bool(window)


def _merge(table: pa.Table, length: int, most: int, schema: pa.Schema) -> pa.Table:
    by = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    found: dict[int, list] = {}
    for row in zip(*(by[c].to_pylist() for c in ("sequence_id", "key", "start", "ids", "doc_tokens")), strict=True):
        found.setdefault(row[0], []).append(row[1:])
    rows = Rows(schema, _MERGED | min(found))
    windows = Windows(length, most)
    sizes = {name: sum(len(p[2]) for p in content) // 4 for name, content in found.items()}
    for name in sorted(found, key=lambda x: (-sizes[x], x)):
        for window in windows.place(sizes[name], found[name]):
            rows.add(window, True)
    for window in pour([p for w in windows.rest() for p in w], length):
        rows.add(window, True)
    return pa.Table.from_batches([rows.take()])


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    tokenizer: str | None = None,
) -> DataFrame:
    """Pieces `(key, start, length, ids, doc_tokens, sequence_id, offset)` of all documents.

    A document is its token ids, then id 0; `ids` holds little-endian unsigned 32-bit values. `start`
    counts the document's ids before the piece, `offset` those of its sequence before it; offsets
    have no gaps. No sequence is longer than `length`; shorter ones are to be padded to it unless
    their size is a power of two. A document of `length` ids or more first fills whole sequences. Null
    and empty texts are the one id 0. Repeated rows and null keys are packed like others.

    A task holds its open windows and one piece of the input; the pieces are written once in the
    shared folder, since open and emitted windows are read apart.
    """
    spark = docs.sparkSession
    schema, arrow = _schema(docs.schema[key].dataType)
    path = scratch_path(spark, "packed")
    _online(docs, key, text, length, open_windows, tokenizer).write.option("compression", "zstd").partitionBy(
        "closed"
    ).parquet(path)
    packed = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    left = packed.where("not closed")
    count = left.agg(F.count_distinct("sequence_id")).first()[0]
    bins = -(-count // MERGE_WINDOWS)
    merged = (
        left.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(max(bins, 1))).alias("bin"))
        .applyInArrow(lambda table: _merge(table, length, open_windows, arrow), schema)
    )
    columns = [F.col("key").alias(key), *schema.fieldNames()[1:-1]]
    return packed.where("closed").unionByName(merged).select(*columns)
