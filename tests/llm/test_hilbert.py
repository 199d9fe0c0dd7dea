from collections import Counter, defaultdict

import pytest
from helpers import documents, empty, frame
from pyspark.sql import functions as F

from demandloom.llm import hilbert as H

DIMENSIONS = ["source", "lang", "n_chars"]


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2)])
def test_the_curve_visits_every_cell_by_single_steps(spark, n, bits):
    side = 1 << bits
    cells = spark.range(side**n).select(*[F.expr(f"cast(id div {side**k} % {side} AS int)").alias(f"d{k}") for k in range(n)])
    path = H.with_hilbert(cells, [f"d{k}" for k in range(n)], bits, "h").orderBy("h").collect()
    assert [r.h for r in path] == list(range(side**n))
    assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(path, path[1:]))


def test_every_row_has_one_place_and_counts_are_even(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "PART_ROWS", 10)
    rows = documents()
    got = H.sharded(frame(spark, rows).withColumn("shard", F.lit(9)), DIMENSIONS, str(tmp_path / "out"))
    assert set(got.columns) == {*frame(spark, []).columns, "shard", "slot"}
    found = got.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_prune_in_every_dimension(spark):
    rows = [(k, "x", "en", f"s{k % 16:02}", k * 7919 % 4096, "", 0, "") for k in range(4096)]
    got = H.hilbert_order(frame(spark, rows), ["source", "n_chars"]).groupBy("shard").agg(
        F.min("source").alias("a"), F.max("source").alias("b"), F.min("n_chars").alias("c"), F.max("n_chars").alias("d")
    )
    area = [(int(r.b[1:]) - int(r.a[1:]) + 1) * (r.d - r.c) / (16 * 4096) for r in got.collect()]
    assert sum(area) < 1.6


def test_hot_cells_ties_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(H, "PART_ROWS", 5)
    rows = [(3, "same", "en", "s", 1, "", 0, "")] * 50
    got = H.hilbert_order(frame(spark, rows), DIMENSIONS).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [6] * 6 + [7] * 2
    assert len({(r.shard, r.slot) for r in got}) == 50
    assert H.hilbert_order(empty(spark), DIMENSIONS).count() == 0
    with pytest.raises(ValueError):
        H.hilbert_order(empty(spark), DIMENSIONS, bits=8)


def test_parts_follow_the_rows_of_their_cell(spark, monkeypatch):
    """One cell has most rows; the others have one part, and files follow the curve without a broadcast too."""
    monkeypatch.setattr(H, "PART_ROWS", 20)
    rows = [(k, "x", "en", "hot" if k % 4 else f"s{k % 16:02}", 5 if k % 4 else k, "", 0, "") for k in range(1600)]
    made = []

    def none(df, row_bytes, bound=0):
        made.append(df.count())
        return df

    want = {(r.doc_id, r.shard, r.slot) for r in H.hilbert_order(frame(spark, rows), ["source", "n_chars"]).collect()}
    monkeypatch.setattr(H, "sized", none)
    ordered = H.hilbert_order(frame(spark, rows), ["source", "n_chars"])
    assert made[0] <= 16 * 16 + 1600 // 20 + 16
    assert {(r.doc_id, r.shard, r.slot) for r in ordered.collect()} == want
    parts = ordered.select(F.spark_partition_id().alias("p"), "shard", "slot").collect()
    places = defaultdict(list)
    for r in parts:
        places[r.p].append(r.shard * 200 + r.slot)
    assert all(x == sorted(x) for x in places.values())
    spans = sorted((min(x), max(x)) for x in places.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_order_equals_a_plain_sort(spark, monkeypatch):
    """Rows of integers sorted by a curve worked out one cell at a time, ties by hash part and key."""
    monkeypatch.setattr(H, "PART_ROWS", 10**6)
    rng = [(k * 37 % 16, k * 61 % 16) for k in range(256)]
    rows = [(k, "x", "en", f"s{a:02}", b, "", 0, "") for k, (a, b) in enumerate(rng)]
    cells = spark.range(256).selectExpr("cast(id div 16 as int) a", "cast(id % 16 as int) b")
    index = {(r.a, r.b): r.h for r in H.with_hilbert(cells, ["a", "b"], 4, "h").collect()}
    # The same curve by quadrants: each is entered where the one before was left.
    def quadrants(order):
        if order == 0:
            return [(0, 0)]
        half, inner = 1 << (order - 1), quadrants(order - 1)
        return (
            [(y, x) for x, y in inner]
            + [(x, y + half) for x, y in inner]
            + [(x + half, y + half) for x, y in inner]
            + [(2 * half - 1 - y, half - 1 - x) for x, y in inner]
        )

    walk = {cell: k for k, cell in enumerate(quadrants(4))}
    mirrored = {cell: walk[cell[::-1]] for cell in walk}
    assert index in (walk, mirrored)
    got = {r.doc_id: (r.shard, r.slot) for r in H.hilbert_order(frame(spark, rows), ["source", "n_chars"]).collect()}
    levels = {}
    for k in range(2):
        cuts = sorted({sorted(x[k] for x in rng)[16 * j - 1] for j in range(1, 16)})
        levels[k] = [sum(x[k] > c for c in cuts) for x in rng]
    want = sorted(range(256), key=lambda i: (index[levels[0][i], levels[1][i]], i))
    assert [got[i] for i in want] == [divmod(place, 32) for place in range(256)]
