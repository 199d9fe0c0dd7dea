"""Quality rules with a verdict by host, in DataFrame functions only.

Every document is measured and judged by the base rules. Failures are then summed by host, each
host's failure rate is shrunk towards the rates of all hosts by a beta prior fitted to them, and the
host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import fresh, staged

#: The white space that separates words, and the symbols that are counted (fixed by the rules).
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
#: Base failure if 100 * repeated words > REPEAT_PERCENT * words.
REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate, less CAUTION standard deviations, exceeds this.
MAX_HOST_RATE = 0.5
CAUTION = 3.0
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, as an array."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def _count_in(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` and the measures of each text (those names are replaced); null is no text.

    Repeated 3-word windows are found inside each row: hashes of the windows are sorted with their
    places, and only places whose hash stands beside an equal one are compared by their words. A text
    of n words costs n log n.
    """
    raw, words, order, near, grams, starts = (fresh(x) for x in ("raw", "words", "order", "near", "grams", "starts"))
    frame = docs.drop(*MEASURES)
    columns = [F.col(f"`{c}`") for c in frame.columns]

    def c(name: str) -> Column:
        return F.col(name)

    frame = frame.select("*", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(raw))
    frame = frame.select("*", words_of(c(raw)).alias(words))
    windows = F.greatest(F.size(words) - 2, F.lit(0))
    hashed = F.transform(
        F.slice(c(words), F.lit(1), windows),
        lambda w, i: F.struct(
            F.xxhash64(w, F.get(c(words), i + 1), F.get(c(words), i + 2)).alias("h"), i.alias("i")
        ),
    )
    frame = frame.select("*", F.sort_array(hashed).alias(order))
    # Places whose hash equals that of a neighbour in the sorted order.
    beside = F.filter(
        c(order),
        lambda x, k: (F.get(c(order), k - 1)["h"] == x["h"]) | (F.get(c(order), k + 1)["h"] == x["h"]),
    )
    frame = frame.select("*", beside.alias(near))
    spelled = F.transform(
        c(near),
        lambda x: F.struct(
            F.struct(
                F.get(c(words), x["i"]).alias("a"),
                F.get(c(words), x["i"] + 1).alias("b"),
                F.get(c(words), x["i"] + 2).alias("c"),
            ).alias("g"),
            x["i"].alias("i"),
        ),
    )
    frame = frame.select("*", F.sort_array(spelled).alias(grams))
    same = F.filter(
        c(grams),
        lambda x, k: (F.get(c(grams), k - 1)["g"] == x["g"]) | (F.get(c(grams), k + 1)["g"] == x["g"]),
    )
    frame = frame.select("*", F.sort_array(F.transform(same, lambda x: x["i"])).alias(starts))
    covered = F.aggregate(
        c(starts),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last")
        ),
    )["n"]
    return frame.select(
        *columns,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(c(raw), WHITE, "")).cast("long").alias("word_chars"),
        _count_in(c(raw), SYMBOLS).alias("n_symbols"),
        _dup_lines(c(raw)).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters by the moments of the hosts' failure rates; `hosts` has `documents` and `failures`.

    The variance that binomial noise alone would give is taken off, so many small hosts do not look
    spread out. One row of sums reaches the driver. Without hosts the prior is flat.
    """
    rate = F.col("failures") / F.col("documents")
    row = hosts.agg(
        F.count("*").alias("k"),
        F.sum("failures").alias("f"),
        F.sum("documents").alias("n"),
        F.avg(rate).alias("mean"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var"),
        F.avg(1 / F.col("documents")).alias("noise"),
    ).first()
    if not row["k"]:
        return 1.0, 1.0
    mean = min(max((row["f"] + 0.5) / (row["n"] + 1.0), 1e-6), 1 - 1e-6)
    spread = mean * (1 - mean)
    var = max(row["var"] - spread * row["noise"], spread / (MAX_STRENGTH + 1))
    strength = min(max(spread / var - 1, MIN_STRENGTH), MAX_STRENGTH)
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """`(host, documents, failures, host_rate, host_rejected)` of every host that is not null.

    `measured` has `base_failed`. Sums are combined before the shuffle, so a host with a third of all
    rows costs one row per task.
    """
    hosts = staged(
        measured.where(F.col(f"`{host}`").isNotNull())
        .groupBy(F.col(f"`{host}`").alias("host"))
        .agg(F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures")),
        "hosts",
    )
    a, b = beta_prior(hosts)
    total = F.col("documents") + F.lit(a + b)
    rate = (F.col("failures") + F.lit(a)) / total
    deviation = F.sqrt(rate * (1 - rate) / (total + 1))
    return hosts.select(
        "host",
        "documents",
        "failures",
        rate.alias("host_rate"),
        (rate - CAUTION * deviation > MAX_HOST_RATE).alias("host_rejected"),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """`key`, the measures, `base_failed`, `host_rate`, `host_rejected` and `kept` of every row.

    A row is kept if it passes the base rules and its host is not rejected. A null text has no words,
    so it fails. A null host is no host: it gets no rate and is never rejected. Repeated rows are
    judged alike; an empty table gives no rows. The measures are written once in the shared folder,
    as both the sums by host and the join back read them.
    """
    measured = measure(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("host")))
    measured = staged(measured.drop("text").withColumn("base_failed", base_failed()), "measured")
    verdicts = host_verdicts(measured, "host").select("host", "host_rate", "host_rejected")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return measured.join(verdicts, "host", "left").select(
        key,
        *MEASURES,
        "base_failed",
        "host_rate",
        rejected.alias("host_rejected"),
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `docs`, with its columns, that pass the base rules and whose host is not rejected.

    Rows are written once with their base verdict, since the sums by host and the result both read
    them; measuring is the costly part and is done once.
    """
    row = fresh("row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{text}`").alias("text"))
    measured = staged(measure(whole).select(row, base_failed().alias("base_failed")), "judged")
    verdicts = host_verdicts(measured.select(F.col(row)[host].alias("host"), "base_failed"), "host")
    rejected = staged(verdicts.where("host_rejected").select("host"), "rejected")
    return (
        measured.where("not base_failed")
        .join(rejected, F.col(row)[host] == F.col("host"), "left_anti")
        .select(*[F.col(row)[c].alias(c) for c in docs.columns])
    )
