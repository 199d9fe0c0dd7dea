"""Hard negatives of anchors among all rows, by one-bit codes with guaranteed intervals.

Vectors are rotated at random; the signs are the code, and its alignment with the vector is stored beside
it. A vector is its alignment times its code plus a residual at right angles to the code. The product
of an anchor with the code follows from popcounts over the bit planes of the quantised anchor; what
the residual and the quantisation can add is bounded by Cauchy and Schwarz. Rows whose interval cannot
reach the best found so far are passed over; the others are scored by their integer product.

Anchors come in waves of bounded size, each sent to all tasks; every task keeps the best rows of each
anchor while it reads, so neither pairs nor groups move, and the results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import staged

EVERY = 100
POSITIVES, NEGATIVES = 5, 5
#: A negative's score in hundredths of the positive's.
LOWEST, HIGHEST = 80, 100
SCALE = 256
#: Anchors and bytes of a wave, and pairs that are bounded at once.
WAVE_ROWS, WAVE_BYTES = 4096, 16 << 20
PAIRS = 1 << 20
PLANES = 6
_EXACT = float(1 << 53)
_SEED = 13


class _Kept(dict):
    """Kept within one process; an empty one travels with functions."""

    def __reduce__(self):
        return _Kept, ()


_rotations = _Kept()


def rotation(dim: int) -> np.ndarray:
    if dim not in _rotations:
        _rotations[dim] = np.linalg.qr(np.random.default_rng((_SEED, dim)).standard_normal((dim, dim)))[0]
    return _rotations[dim]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, alignment and norm of the residual of every row."""
    n, dim = x.shape
    turned = x.astype(np.float64) @ rotation(dim)
    bits = np.packbits(turned >= 0, axis=1)
    words = np.zeros((n, -(-dim // 64) * 8), np.uint8)
    words[:, : bits.shape[1]] = bits
    align = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    rest = np.sqrt(np.maximum((turned**2).sum(axis=1) - align**2, 0))
    return words.view(np.uint64), align, rest


class Anchors:
    """The anchors of one wave with the bit planes of their rotated, quantised vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        n, dim = x.shape
        turned = x.astype(np.float64) @ rotation(dim)
        self.norm = np.sqrt((turned**2).sum(axis=1))
        self.low = turned.min(axis=1, keepdims=True)
        step = (turned.max(axis=1, keepdims=True) - self.low) / ((1 << PLANES) - 1)
        self.step = np.where(step > 0, step, 1.0)
        levels = np.rint((turned - self.low) / self.step).astype(np.int64)
        rounded = self.low + self.step * levels
        self.total = rounded.sum(axis=1, keepdims=True)
        self.off = np.sqrt(((turned - rounded) ** 2).sum(axis=1, keepdims=True))
        width = -(-dim // 64) * 8
        self.planes = np.zeros((PLANES, n, width), np.uint8)
        for k in range(PLANES):
            bits = np.packbits((levels >> k & 1).astype(bool), axis=1)
            self.planes[k, :, : bits.shape[1]] = bits
        self.planes = self.planes.view(np.uint64)
        self.dim = dim

    def intervals(self, some: np.ndarray, codes: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple:
        """Least and largest product of each of `some` anchors with each row."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.float64)
        hits = np.zeros((len(some), len(codes)))
        for k in range(PLANES):
            for w in range(codes.shape[1]):
                hits += np.bitwise_count(self.planes[k, some, w][:, None] & codes[None, :, w]) * float(1 << k)
        along = (2 * (self.low[some] * ones + self.step[some] * hits) - self.total[some]) / np.sqrt(self.dim)
        off, norm = self.off[some], self.norm[some][:, None]
        nearest = np.clip(np.abs(along) - off, 0, norm)
        wide = rest * np.sqrt(norm**2 - nearest**2)
        slack = wide + align * off + 1e-9 * (norm * (align + rest)) + 1e-6
        centre = align * along
        return centre - slack, centre + slack


class Best:
    """The first rows of every slot, by score and then by key."""

    def __init__(self, slots: int, most: int) -> None:
        self.most = most
        self.slot = np.zeros(0, np.int64)
        self.score, self.id = self.slot, self.slot
        #: The score that a further row has to reach.
        self.bar = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        good = score >= self.bar[slot]
        slot, score, id_ = (np.concatenate([x, y[good]]) for x, y in ((self.slot, slot), (self.score, score), (self.id, id_)))
        by = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[by], score[by], id_[by]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.most - 1
        self.bar[slot[last]] = score[last]
        keep = rank < self.most
        self.slot, self.score, self.id = slot[keep], score[keep], id_[keep]


def scores(a: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer products of the wanted (anchor, row) pairs."""
    i, j = np.nonzero(wanted)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if bound < _EXACT and 8 * len(i) > wanted.size:
        # Sums below 2**53 are exact in double precision, in any order.
        return i, j, (a.astype(np.float64) @ x.T.astype(np.float64))[i, j].astype(np.int64)
    out = np.zeros(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        out[part] = (a[i[part]] * x[j[part]]).sum(axis=1)
    return i, j, out


def _positives(anchors: Anchors, batches: Iterator[tuple]) -> Best:
    """The first rows of each anchor's own label, but not of its own key."""
    best = Best(len(anchors.ids), POSITIVES)
    for ids, labels, x, codes, align, rest in batches:
        for label in np.intersect1d(labels, anchors.labels):
            own, rows = np.flatnonzero(anchors.labels == label), np.flatnonzero(labels == label)
            _, high = anchors.intervals(own, codes[rows], align[rows], rest[rows])
            wanted = (high >= best.bar[own][:, None]) & (anchors.ids[own][:, None] != ids[rows])
            i, j, score = scores(anchors.x[own], x[rows], wanted)
            best.add(own[i], score, ids[rows][j])
    return best


def _negatives(anchors: Anchors, slots: np.ndarray, tops: np.ndarray, batches: Iterator[tuple]) -> Best:
    """The first rows of other labels in the range of each (anchor, positive)."""
    best = Best(len(slots), NEGATIVES)
    which, first = np.unique(slots, return_index=True)
    # Ranges are closed, so bounds on scores in doubles err on the wide side by the intervals' slack.
    floors, ceiling = tops * (LOWEST / HIGHEST), np.maximum.reduceat(tops, first) if len(tops) else tops
    for ids, labels, x, codes, align, rest in batches:
        low, high = anchors.intervals(which, codes, align, rest)
        bar = np.minimum.reduceat(np.maximum(floors, best.bar), first)
        wanted = (high >= bar[:, None]) & (low <= ceiling[:, None]) & (anchors.labels[which][:, None] != labels)
        i, j, score = scores(anchors.x[which], x, wanted)
        ends = np.append(first, len(slots))
        for k in range(int(np.diff(ends).max(initial=0))):
            slot = first[i] + k
            here = slot < ends[i + 1]
            slot, some, row = slot[here], score[here], j[here]
            top = tops[slot].astype(np.int64)
            fits = (LOWEST * top <= HIGHEST * some) & (some <= top)
            best.add(slot[fits], some[fits], ids[row][fits])
    return best


def _rows(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows (id, label, x): whole-number vectors of the rows that take part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for v in batch.column(2):
                raw = None
                if v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all():
                        raw = np.clip(np.floor(SCALE * x), -(2.0**62), 2.0**62).astype("<i8").tobytes()
                out.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "x"]
            )

    some = df.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ).where("id is not null and label is not null and vector is not null")
    return some.mapInArrow(scan, "id long, label long, x binary").where("x is not null")


def _vectors(column, dim: int) -> np.ndarray:
    """Whole-number vectors of one length; missing components are 0."""
    raw = column.to_pylist()
    if all(len(x) == 8 * dim for x in raw):
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), dim)
    return np.frombuffer(b"".join(x.ljust(8 * dim, b"\0") for x in raw), "<i8").reshape(len(raw), dim)


def _coded(rows: DataFrame, dim: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words, align, rest = encode(_vectors(part.column(2), dim))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([w.tobytes() for w in words], pa.binary()), pa.array(align), pa.array(rest)],
                    names=["id", "label", "x", "code", "align", "rest"],
                )

    return rows.mapInArrow(scan, "id long, label long, x binary, code binary, align double, rest double")


def _chunks(batches: Iterator[pa.RecordBatch], dim: int, anchors: int) -> Iterator[tuple]:
    step = max(1, PAIRS // max(1, anchors))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            ids, labels, align, rest = (batch.column(k).to_numpy() for k in (0, 1, 4, 5))
            yield ids, labels, _vectors(batch.column(2), dim), codes, align, rest


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)


def hard_negatives(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = EVERY,
    wave_rows: int = WAVE_ROWS,
) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`.

    Components become floor(256 x); a score is the integer product with the anchor, and higher scores
    come first, then smaller keys. Anchors are the rows whose key `every` divides. Positives are an
    anchor's first 5 rows of its label and another key; each gets the first 5 rows of other labels whose
    score is 80 to 100 hundredths of its own. Rows without a key or a label, and vectors that are null
    or hold null or non-finite components, take no part. Of rows that agree in key, label and vector
    one counts. A shorter vector goes on with zeros. Other columns of `df` are not read; an empty
    table gives an empty one. Keys and labels must be whole numbers, and scores must fit in a long.

    Every row is read twice for each wave of `wave_rows` anchors (fewer if their vectors exceed 16 MB);
    a task holds the wave and 30 rows for each of its anchors, whatever the labels' sizes.
    """
    spark = df.sparkSession
    rows = staged(_rows(df, key, vector, label).distinct(), "vectors")
    size = rows.agg(F.max(F.length("x"))).first()[0]
    dim = max(1, (size or 8) // 8)
    coded = staged(_coded(rows, dim), "codes")
    anchors = coded.where(F.col("id") % every == 0)
    most = max(1, min(wave_rows, WAVE_BYTES // (8 * dim)))
    total = anchors.count()
    waves = max(1, -(-total // most))
    wave_of = F.pmod(F.xxhash64("id", "label", "x"), F.lit(waves))
    kind = "slot long, score long, id long"
    parts = []
    for wave in range(waves):
        table = anchors.where(wave_of == wave).select("id", "label", "x").toArrow()
        if not table.num_rows:
            continue
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        shared = spark.sparkContext.broadcast((ids, labels, _vectors(table["x"].combine_chunks(), dim)))

        def positives(batches, shared=shared):
            own = Anchors(*shared.value)
            best = _positives(own, _chunks(batches, dim, len(own.ids)))
            yield _batch(best)

        first = _first(coded.mapInArrow(positives, kind), ["slot"], POSITIVES).select("slot", "id", "score")
        # At most five rows for each anchor of the wave.
        found = first.toArrow().sort_by([("slot", "ascending"), ("score", "descending"), ("id", "ascending")])
        slots, tops, names = (found[c].to_numpy() for c in ("slot", "score", "id"))
        ranges = spark.sparkContext.broadcast((slots, tops))

        def negatives(batches, shared=shared, ranges=ranges):
            own, (slots, tops) = Anchors(*shared.value), ranges.value
            if len(slots):
                yield _batch(_negatives(own, slots, tops, _chunks(batches, dim, len(own.ids))))

        mined = _first(coded.mapInArrow(negatives, kind), ["slot"], NEGATIVES)
        known = spark.createDataFrame(
            pa.table({"slot": np.arange(len(slots)), "anchor_id": ids[slots], "positive_id": names, "positive_score": tops}),
            "slot long, anchor_id long, positive_id long, positive_score long",
        )
        parts.append(
            staged(
                mined.join(F.broadcast(known), "slot").select(
                    "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
                ),
                "negatives",
            )
        )
        shared.unpersist()
        ranges.unpersist()
    if not parts:
        return spark.createDataFrame(
            [],
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _batch(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(best.slot), pa.array(best.score), pa.array(best.id)], names=["slot", "score", "id"]
    )
