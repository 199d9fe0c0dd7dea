"""Line dedup over content-defined chunks of lines.

The lines of a text that have words are cut into chunks where their content says so: beside every
line of `long_line` words or more, and after a line at which a rolling hash over the hashes of the
last `window` lines falls on a fixed residue. Boundaries thus follow the lines themselves, so a
passage that is shifted, or embedded in another text, falls into the same chunks again.

The chunks at both ends of a passage of short lines hold lines of their surroundings. So there are
also, from every line on and up to every line, the fewest lines that hold `min_words` words; those of
long lines alone are chunks already. Together they cover every line of a passage of `min_words` words.

Chunks and such windows are counted by hash over all documents. The bytes of those that repeat are
then grouped, which compares them byte by byte, and every occurrence but the first (smallest key, then
place) is repeated, unless it overlaps the first. Repeated lines in a row form a run; runs of
`min_words` words or more are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, sized, staged
from .words import CHUNK_BYTES, NEWLINE, SPACE, as_long, pieces, runs, shingle_hashes, span_hashes, text_bytes

LONG_LINE = 12
WINDOW = 2
DIVISOR = 3
MIN_WORDS = 40
#: Most rows of chunks in one batch.
BATCH_ROWS = 1 << 14


def text_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, words and text number of every line with words."""
    starts, ends, _ = runs(data, offsets, NEWLINE)
    word_starts, _, _ = runs(data, offsets, SPACE)
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    starts, ends, words = starts[words > 0], ends[words > 0], words[words > 0]
    return starts, ends, words, np.searchsorted(offsets, starts, side="right") - 1


def _chunk_lines(
    data: np.ndarray, lines: tuple[np.ndarray, ...], long_line: int, window: int, divisor: int
) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every chunk."""
    starts, ends, words, text = lines
    n = len(starts)
    if n == 0:
        return starts, starts
    rolling = shingle_hashes(span_hashes(data, starts, ends), window)
    cut = np.zeros(n, dtype=bool)
    cut[-1] = True
    cut[:-1] = text[1:] != text[:-1]
    wide = words >= long_line
    cut |= wide
    cut[:-1] |= wide[1:]
    if len(rolling):
        full = text[window - 1 :] == text[: n - window + 1]
        cut[window - 1 :] |= full & (rolling % np.uint64(divisor) == 0)
    last = np.flatnonzero(cut)
    return np.concatenate([[0], last[:-1] + 1]), last


def chunk_spans(
    data: np.ndarray, offsets: np.ndarray, long_line: int, window: int, divisor: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, words and text number of every chunk; ends leave out the last line break."""
    lines = text_lines(data, offsets)
    starts, ends, words, text = lines
    first, last = _chunk_lines(data, lines, long_line, window, divisor)
    total = np.concatenate([[0], np.cumsum(words)])
    return starts[first], ends[last], total[last + 1] - total[first], text[first]


def _window_lines(words: np.ndarray, text: np.ndarray, long_line: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the fewest lines of `min_words` words from and up to every line, if any is short."""
    n, least = len(words), max(min_words, 1)
    total = np.concatenate([[0], np.cumsum(words)])
    every = np.arange(n)
    first = np.concatenate([every, np.searchsorted(total, total[1:] - least, side="right") - 1])
    last = np.concatenate([np.searchsorted(total, total[:-1] + least) - 1, every])
    inside = (first >= 0) & (last < n)
    first, last = first[inside], last[inside]
    short = np.concatenate([[0], np.cumsum(words < long_line)])
    kept = (text[first] == text[last]) & (short[last + 1] > short[first])
    return first[kept], last[kept]


def _chunks(
    docs: DataFrame, key: str, text: str, shape: tuple[int, int, int], min_words: int, with_bytes: bool
) -> DataFrame:
    """Chunks and windows: key, lines, hash, length, words before and up to the end, bytes from and to.

    With their bytes if asked for.
    """
    kind = docs.schema[key].dataType
    names = ["place", "upto", "hash", "length", "before", "after", "low", "high"]
    fields = [T.StructField("key", kind)] + [T.StructField(name, T.LongType()) for name in names]
    fields += [T.StructField("bytes", T.BinaryType())] * with_bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            data, offsets = text_bytes(batch.column(text))
            lines = text_lines(data, offsets)
            line_starts, line_ends, words, line_text = lines
            n = len(words)
            if n == 0:
                continue
            both = zip(_chunk_lines(data, lines, *shape), _window_lines(words, line_text, shape[0], min_words), strict=True)
            first, last = (np.concatenate(x) for x in both)
            first, last = np.divmod(np.unique(first * n + last), n)
            starts, ends, owner = line_starts[first], line_ends[last], line_text[first]
            top = np.searchsorted(line_text, owner, side="left")
            total = np.concatenate([[0], np.cumsum(words)])
            stop = ends + ((ends < offsets[owner + 1]) & (data[np.minimum(ends, len(data) - 1)] == 0x0A))
            numbers = [
                first - top,
                last + 1 - top,
                span_hashes(data, starts, ends),
                ends - starts,
                total[first] - total[top],
                total[last + 1] - total[top],
                starts - offsets[owner],
                stop - offsets[owner],
            ]
            raw = data.tobytes() if with_bytes else b""
            # Windows overlap, so their bytes may be many times the text's.
            size = np.concatenate([[0], np.cumsum(ends - starts)]) if with_bytes else np.zeros(len(first) + 1, np.int64)
            a = 0
            while a < len(first):
                b = int(np.searchsorted(size, size[a] + CHUNK_BYTES, side="right")) - 1
                b = min(max(b, a + 1), a + BATCH_ROWS, len(first))
                columns = [batch.column(key).take(pa.array(owner[a:b])), *(as_long(x[a:b]) for x in numbers)]
                if with_bytes:
                    spans = zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)
                    columns.append(pa.array([raw[x:y] for x, y in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
                a = b

    return (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).alias(key), F.col(text).alias(text))
        .mapInArrow(scan, T.StructType(fields))
    )


def repeated_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    long_line: int = LONG_LINE,
    window: int = WINDOW,
    divisor: int = DIVISOR,
) -> DataFrame:
    """`(key, spans, n_runs, n_words)` of documents with runs to remove; spans are byte ranges in order.

    The first occurrence of a chunk or window, by key and place, does not count as repeated. Rows without a key and null
    texts have no chunks. Rows that repeat a key count as one document, so none of them is cut for
    the other's sake.
    """
    shape = (long_line, window, divisor)
    hashed = _chunks(docs, key, text, shape, min_words, with_bytes=False)
    often = staged(
        hashed.groupBy("hash", "length").agg(F.count("*").alias("times")).where("times > 1").select("hash", "length"),
        "repeated",
    )
    found = staged(
        _chunks(docs, key, text, shape, min_words, with_bytes=True)
        .join(sized(often, 24), ["hash", "length"], "left_semi")
        .withColumn("digest", F.sha2("bytes", 256)),
        "occurrences",
    )
    # Grouping by the bytes compares them; the digest then names the group without carrying them on.
    same = (
        found.groupBy("hash", "digest", "bytes")
        .agg(F.count("*").alias("times"), F.min(F.struct("key", "place")).alias("first"))
        .groupBy("hash", "digest")
        .agg(F.count("*").alias("texts"), F.sum("times").alias("times"), F.min("first").alias("first"))
        .where("texts = 1 and times > 1")
        .select("hash", "digest", "first")
    )
    again = (
        found.select("key", "place", "upto", "before", "after", "low", "high", "hash", "digest")
        .join(sized(staged(same, "verified"), 160), ["hash", "digest"])
        .where("not (key <=> first.key and place < first.place + upto - place)")
        .select("key", "place", "upto", "before", "after", "low", "high")
        .distinct()
    )
    order = Window.partitionBy("key").orderBy("place", "upto")
    reached = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = again.withColumn("apart", (F.coalesce(reached, F.lit(-1)) < F.col("place")).cast("long"))
    long_runs = (
        apart.withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "island")
        .agg(
            (F.max("after") - F.min("before")).alias("words"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        .where(F.col("words") >= min_words)
    )
    return long_runs.groupBy(F.col("key").alias(key)).agg(
        F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"),
        F.count("*").alias("n_runs"),
        F.sum("words").alias("n_words"),
    )


def _without(text, spans):
    """The text's bytes outside the spans, which are in order and apart."""
    raw = text.cast("binary")
    start = F.struct(F.lit(b"").alias("out"), F.lit(0).cast("long").alias("at"))

    def keep(state, span):
        piece = F.substring(raw, (state["at"] + 1).cast("int"), (span["low"] - state["at"]).cast("int"))
        return F.struct(F.concat(state["out"], piece).alias("out"), span["high"].alias("at"))

    left = F.aggregate(spans, start, keep)
    rest = F.substring(raw, (left["at"] + 1).cast("int"), F.lit(2**31 - 1))
    return F.concat(left["out"], rest).cast("string")


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", drop_emptied: bool = False, counts: str | None = None, **kw
) -> DataFrame:
    """`docs` with its repeated runs cut out of `text`; every other row and column stays as it is.

    `counts` names a prefix for two more columns, the runs and words removed. `drop_emptied` leaves out
    rows that had words and have none left, such as exact copies of a document with a smaller key.
    """
    spans, n_runs, n_words, own = fresh("spans"), fresh("runs"), fresh("words"), fresh("key")
    found = staged(repeated_runs(docs, key, text, **kw), "runs").select(
        F.col(key).alias(own), F.col("spans").alias(spans), F.col("n_runs").alias(n_runs), F.col("n_words").alias(n_words)
    )
    joined = docs.join(sized(found, F.size(spans) * 16 + 40), F.col(f"`{key}`") == F.col(own), "left")
    cut = F.when(F.col(spans).isNull(), F.col(f"`{text}`")).otherwise(_without(F.col(f"`{text}`"), F.col(spans)))
    out = joined.withColumn(text, cut)
    if drop_emptied:
        out = out.where(F.col(spans).isNull() | F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"))
    extra = [] if counts is None else [
        F.coalesce(F.col(n_runs), F.lit(0)).cast("long").alias(f"{counts}runs"),
        F.coalesce(F.col(n_words), F.lit(0)).cast("long").alias(f"{counts}words"),
    ]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if not (counts and c in (f"{counts}runs", f"{counts}words"))], *extra)
