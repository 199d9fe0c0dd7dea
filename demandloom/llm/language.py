"""Language of whole texts: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters (letters lower-cased, everything else one blank) fall into
2**BITS hash buckets. Document frequencies come from all training documents. The weights are trained on a
bounded sample by follow-the-regularised-leader with elastic-net penalties, and a temperature is
fitted on a part of the sample that training has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import sized, staged
from .words import mix, pieces, text_bytes

BITS = 14
NGRAMS = 3
#: Training documents of each language that the weights are fitted on, and languages that are learned.
SAMPLE_PER_LANGUAGE = 1500
MOST_LANGUAGES = 64
EPOCHS = 3
#: Step size, its offset, and the elastic-net penalties on absolute and squared weights.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-4, 1e-3
#: One sampled document in so many is kept for the temperature.
CALIBRATE_EVERY = 5
UNDETERMINED = "und"

#: Letters below this code point are looked up in a table; texts without any are looked at one by one.
_TABLE = 0x3000


def letter_table() -> np.ndarray:
    """Lower-cased code point of each letter below `_TABLE`, else 0."""
    out = np.zeros(_TABLE + 1, np.uint32)
    for k in range(_TABLE):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 and ord(low) < _TABLE else k
    return out


class Counter:
    """Bucket counts of each text of a batch."""

    def __init__(self) -> None:
        self.letters = letter_table()

    def counts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, bool]]:
        """For each text the counts by bucket (the same array, anew each time) and whether it has a letter."""
        data, offsets = text_bytes(column)
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = (data & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(begins)])[offsets]
        folded = self.letters[np.minimum(codes, _TABLE)]
        letter = np.concatenate([[0], np.cumsum(folded > 0)])
        high = np.concatenate([[0], np.cumsum(codes >= _TABLE)])
        kept = np.where(codes >= _TABLE, codes, folded).astype(np.uint64)
        buckets = []
        value = np.zeros(len(kept), np.uint64)
        blank = np.ones(len(kept), bool)
        for n in range(NGRAMS):
            size = len(kept) - n
            value, blank = value[:size], blank[:size]
            value = (value << np.uint64(21)) | kept[n:]
            blank = blank & (kept[n:] == 0)
            mixed = (mix(value, n) >> np.uint64(64 - BITS)).astype(np.int32)
            # Runs of blanks say nothing; they share a bucket that is cleared below.
            mixed[blank] = 1 << BITS
            buckets.append(mixed)
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            total = np.zeros((1 << BITS) + 1, np.int64)
            for n, mixed in enumerate(buckets):
                if b - n > a:
                    total += np.bincount(mixed[a : b - n], minlength=(1 << BITS) + 1)
            known = letter[b] > letter[a]
            if not known and high[b] > high[a]:
                known = any(c.isalpha() for c in column[k].as_py())
            yield total[:-1], bool(known)


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their TF-IDF, scaled to length one."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (class, bucket) by FTRL-proximal over `(buckets, values, class)` in the given order."""
    z, n = np.zeros((classes, 1 << BITS)), np.zeros((classes, 1 << BITS))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        active = np.abs(zs) > L1
        return np.where(active, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, x, label in rows:
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            score = w @ x
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * x[None, :]
            n_new = ns + g * g
            z[:, at] = zs + g - (np.sqrt(n_new) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = n_new
    return weights(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, from 1/64 to 16, at which the labels are most likely (golden section on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    low, high = np.log(1 / 64), np.log(16.0)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def _frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and all documents, over the whole of `docs`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, rows = Counter(), np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in pieces(batches, text):
            for counts, _ in counter.counts(batch.column(text)):
                held[:-1] += counts > 0
            rows += batch.num_rows
        held[-1] = rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "df"])

    # At most 2**BITS + 1 rows reach the driver, whatever the size of the table.
    table = docs.select(text).mapInArrow(scan, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[table["bucket"].to_numpy()] = table["df"].to_numpy()
    return df[:-1], int(df[-1])


def _sample(train: DataFrame, key: str, lang: str, per_language: int, most: int) -> tuple[DataFrame, list[str]]:
    """`(key, label, turn)` of the sample; `turn` is its random but fixed order. Classes by name."""
    sizes = train.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    classes = sorted(r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(most).collect())
    if not classes:
        return train.select(key, F.lit(0).alias("label"), F.lit(0).cast("long").alias("turn")).limit(0), classes
    number = F.coalesce(*[F.when(F.col(lang) == c, F.lit(k)) for k, c in enumerate(classes)])
    turn = F.xxhash64(F.lit("sample"), F.col(key))
    ranked = train.select(key, number.alias("label"), turn.alias("turn")).where("label is not null")
    order = Window.partitionBy("label").orderBy("turn", key)
    return ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).drop("r"), classes


def learn(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    most_languages: int = MOST_LANGUAGES,
) -> dict:
    """The model of the labelled rows of `docs`; rows with a null key, text or label teach nothing.

    Document frequencies cover all of them. The weights are fitted on `per_language` rows, by hash
    order, of each of the `most_languages` most frequent labels, which bounds the one task that trains.
    """
    train = docs.select(key, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    df, rows = _frequencies(train, text)
    idf = np.log((1 + rows) / (1 + df)) + 1
    chosen, classes = _sample(train, key, lang, per_language, most_languages)
    if not classes:
        return {"classes": [], "weights": np.zeros((0, 1 << BITS)), "idf": idf, "temperature": 1.0}
    chosen = staged(chosen.dropDuplicates([key]), "sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in pieces(batches, text):
            at_out, x_out = [], []
            for counts, _ in counter.counts(batch.column(text)):
                at, x = weighted(counts, idf)
                at_out.append(at.astype("<u2").tobytes())
                x_out.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("turn"), pa.array(at_out, pa.binary()), pa.array(x_out, pa.binary())],
                names=["label", "turn", "buckets", "x"],
            )

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending")])
        seen = [
            (np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(x, "<f4").astype(float), label)
            for a, x, label in zip(*(table[c].to_pylist() for c in ("buckets", "x", "label")), strict=True)
        ]
        held = seen[::CALIBRATE_EVERY] if len(seen) >= 10 * CALIBRATE_EVERY else []
        rest = [r for k, r in enumerate(seen) if k % CALIBRATE_EVERY] if held else seen
        weights = train_ftrl(rest, len(classes))
        scores = np.array([weights[:, at] @ x for at, x, _ in held]).reshape(len(held), len(classes))
        temperature = fit_temperature(scores, np.array([y for _, _, y in held], int))
        return pa.table(
            {"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()), "temperature": pa.array([temperature])}
        )

    texts = train.select(key, text).join(sized(chosen, 24), key).select(text, "label", "turn")
    counted = texts.mapInArrow(features, "label int, turn long, buckets binary, x binary")
    model = staged(
        counted.groupBy(F.lit(1).alias("one")).applyInArrow(fit, "weights binary, temperature double"), "model"
    ).first()
    if model is None:
        return {"classes": [], "weights": np.zeros((0, 1 << BITS)), "idf": idf, "temperature": 1.0}
    weights = np.frombuffer(model["weights"], "<f4").reshape(len(classes), 1 << BITS)
    return {"classes": classes, "weights": weights, "idf": idf, "temperature": model["temperature"]}


def predict(docs: DataFrame, model: dict, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the predicted language and its calibrated probability (columns of these names are replaced).

    Null texts and texts without a letter are `und` with score 0; so is every text if nothing was learned.
    """
    frame = docs.drop(lang_pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names_in = frame.columns
    schema = T.StructType(
        [*frame.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counter = shared.value, Counter()
        weights = np.ascontiguousarray(known["weights"], dtype=np.float32)
        idf, classes, heat = known["idf"].astype(np.float32), known["classes"], known["temperature"]
        for batch in pieces(batches, text):
            names, scores = [], []
            for counts, letter in counter.counts(batch.column(text)):
                if not letter or not classes:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                at, x = weighted(counts, idf)
                s = (weights[:, at] @ x.astype(np.float32)).astype(float) / heat
                p = np.exp(s - s.max())
                best = int(p.argmax())
                names.append(classes[best])
                scores.append(float(p[best] / p.sum()))
            columns = [batch.column(c) for c in names_in]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*names_in, lang_pred, score]
            )

    return frame.mapInArrow(scan, schema)
