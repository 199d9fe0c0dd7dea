"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scanned over token windows.

Texts are lower-cased (A-Z) and cut into words of digits, lower-case letters and non-ASCII
characters. Every run of `width` item words is a window; an item with fewer words is one window.
Executors look up the hash of every document window in the broadcast set and compare the words of
each hit with the item's words before it counts. Words inside a verified window are hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, staged
from .words import LOWER, NOT_ALNUM, pieces, runs, shingle_hashes, span_hashes, text_bytes

WIDTH = 13
#: Bytes of benchmark text in one broadcast; a larger benchmark is scanned block by block.
BLOCK_BYTES = 1 << 20
#: A document is contaminated if it has a hit and RATIO * hit words >= words.
RATIO = 20


class WindowSet:
    """Windows of one block of benchmark items: hash -> (words, items), by window length."""

    def __init__(self, lengths: dict[int, tuple[np.ndarray, np.ndarray, dict]]) -> None:
        self.lengths = lengths

    @classmethod
    def build(cls, items: list[tuple[str | None, str]], width: int) -> WindowSet:
        windows: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = runs(data, np.array([0, len(data)]), NOT_ALNUM)
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
            size = min(width, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                windows[size][tuple(words[k : k + size])].add(item)
        lengths: dict[int, tuple[np.ndarray, np.ndarray, dict]] = {}
        for size, found in windows.items():
            by_hash: dict[int, list] = defaultdict(list)
            for words, owners in found.items():
                raw = b" ".join(words)
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = runs(data, np.array([0, len(data)]), NOT_ALNUM)
                value = shingle_hashes(span_hashes(data, starts, ends), size)[0]
                by_hash[int(value)].append((words, tuple(sorted(x for x in owners if x is not None))))
            keys = np.array(sorted(by_hash), dtype=np.uint64)
            screen = np.zeros(1 << 20, dtype=bool)
            screen[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            lengths[size] = (keys, screen, dict(by_hash))
        return cls(lengths)

    def hits(self, hashes: np.ndarray, size: int) -> np.ndarray:
        keys, screen, _ = self.lengths[size]
        maybe = np.flatnonzero(screen[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.searchsorted(keys, hashes[maybe])
        at[at == len(keys)] = 0
        return maybe[keys[at] == hashes[maybe]]


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> list[DataFrame]:
    rows = benchmark.where(F.col(text).isNotNull()).select(
        F.col(item).cast("string").alias("item"), F.col(text).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
    count = -(-int(total) * 2 // limit) if total > limit else 1
    if count == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) for k in range(count)]


def _scan(docs: DataFrame, text: str, spans: str, items: str, count: str, block: WindowSet) -> DataFrame:
    """Adds the verified windows of one block to the columns that earlier blocks have filled."""
    shared = docs.sparkSession.sparkContext.broadcast(block.lengths)
    kept = [f for f in docs.schema.fields if f.name not in (spans, items, count)]
    schema = T.StructType(
        [
            *kept,
            T.StructField(spans, T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField(items, T.ArrayType(T.StringType())),
            T.StructField(count, T.LongType()),
        ]
    )
    first = spans not in docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(shared.value)
        for batch in pieces(batches, text):
            data, offsets = text_bytes(batch.column(text))
            data = LOWER[data]
            starts, ends, firsts = runs(data, offsets, NOT_ALNUM)
            hashes = span_hashes(data, starts, ends)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            found: dict[int, tuple[list, set]] = {}
            if not first:
                for row, (old, names) in enumerate(
                    zip(batch.column(spans).to_pylist(), batch.column(items).to_pylist(), strict=True)
                ):
                    if old:
                        found[row] = ([tuple(x[:2]) for x in old], set(names))
            for size, (_, _, by_hash) in known.lengths.items():
                windows = shingle_hashes(hashes, size)
                for at in known.hits(windows, size).tolist():
                    row = int(owner[at])
                    if owner[at + size - 1] != row:
                        continue
                    words = tuple(data[starts[k] : ends[k]].tobytes() for k in range(at, at + size))
                    for wanted, owners in by_hash[int(windows[at])]:
                        if wanted == words:
                            base = int(firsts[row])
                            entry = found.setdefault(row, ([], set()))
                            entry[0].append((at - base, at - base + size))
                            entry[1].update(owners)
            out_spans: list = [[] for _ in range(batch.num_rows)]
            out_items: list = [[] for _ in range(batch.num_rows)]
            for row, (pairs, names) in found.items():
                base, begin = int(firsts[row]), int(offsets[row])
                merged: list[list[int]] = []
                for low, high in sorted(set(pairs)):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                out_spans[row] = [
                    [low, high, int(starts[base + low]) - begin, int(ends[base + high - 1]) - begin]
                    for low, high in merged
                ]
                out_items[row] = sorted(names)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in kept),
                    pa.array(out_spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array(out_items, pa.list_(pa.string())),
                    pa.array(np.diff(firsts).astype(np.int64)),
                ],
                names=[f.name for f in kept] + [spans, items, count],
            )

    return docs.mapInArrow(scan, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
    prefix: str = "bench_",
) -> DataFrame:
    """All rows and columns of `docs` with the verified hits of every benchmark window.

    Adds `<prefix>words` (words of the text), `<prefix>spans` (merged hit runs as [first word, word
    after the last, first byte, byte after the last]), `<prefix>hit` (words in them), `<prefix>items`
    (ids, as strings in order, of the items with a window there) and `<prefix>contaminated`. Columns
    of these names in `docs` are replaced.

    A benchmark of at most `block_bytes` is one broadcast. A larger one is scanned in blocks of items,
    each broadcast alone, with the documents and their hits so far written between blocks, so neither
    the driver nor an executor ever holds more than a block. Null texts have no words; items without
    words have no window; those without an id count as hits but are not named; an empty benchmark leaves every document clean; repeated
    documents and items are judged row by row.
    """
    names = {k: f"{prefix}{k}" for k in ("words", "spans", "hit", "items", "contaminated")}
    frame = docs.drop(*names.values())
    spans, items, count = fresh("spans"), fresh("items"), fresh("count")
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    for k, rows in enumerate(blocks):
        block = WindowSet.build([(r["item"], r["text"]) for r in rows.collect()], width)
        frame = _scan(frame, text, spans, items, count, block)
        if k < len(blocks) - 1:
            frame = staged(frame, "scanned")
    hit = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return frame.select(
        *[F.col(f"`{c}`") for c in frame.columns if c not in (spans, items, count)],
        F.col(count).alias(names["words"]),
        F.col(spans).alias(names["spans"]),
        hit.alias(names["hit"]),
        F.col(items).alias(names["items"]),
        ((hit > 0) & (hit * RATIO >= F.col(count))).alias(names["contaminated"]),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", action: str = "documents", **kw
) -> DataFrame:
    """`docs` without contaminated documents, or (`action="spans"`) with their hit spans cut out.

    Documents that are not contaminated stay as they are, also if a few of their words are hit.
    """
    if action not in ("documents", "spans"):
        raise ValueError("action is 'documents' or 'spans'")
    prefix = fresh("b")
    found = find_contamination(docs, benchmark, text=text, prefix=prefix, **kw)
    bad = F.col(f"{prefix}contaminated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if action == "documents":
        return found.where(~bad).select(*columns)
    raw = F.col(f"`{text}`").cast("binary")

    def keep(state, span):
        # Bytes between the end of the last span and the start of this one.
        piece = F.substring(raw, (state["at"] + 1).cast("int"), (span[2] - state["at"]).cast("int"))
        return F.struct(F.concat(state["out"], piece).alias("out"), span[3].alias("at"))

    start = F.struct(F.lit(b"").alias("out"), F.lit(0).cast("long").alias("at"))
    left = F.aggregate(F.col(f"{prefix}spans"), start, keep)
    rest = F.substring(raw, (left["at"] + 1).cast("int"), F.lit(2**31 - 1))
    cut = F.concat(left["out"], rest).cast("string")
    return found.withColumn(text, F.when(bad, cut).otherwise(F.col(f"`{text}`"))).select(*columns)


def digest(items) -> F.Column:
    """Lower-case hex SHA-256 of the sorted ids joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)


