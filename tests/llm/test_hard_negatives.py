"""Hard negatives against all products, and the intervals of codes against exact ones."""

import math
import random

import numpy as np
import pytest
from helpers import ordered

from demandloom.llm.hard_negatives import Anchors, encode, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, code string, slot long, score double"


def plain(rows: list[tuple]) -> list[tuple]:
    live = {}
    for key, v, label, *_ in rows:
        if None not in (key, v, label) and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(256 * float(np.float32(y))) for y in v]
            live[key, label, tuple(x + [0] * (9 - len(x)))] = None
    live = sorted(live)
    out = []
    for a, mine, u in live:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(u, v, strict=True)), k, label) for k, label, v in live)
        for minus, positive, _ in [s for s in scored if s[2] == mine and s[1] != a][:5]:
            others = [s for s in scored if s[2] != mine and 80 * -minus <= 100 * -s[0] <= 100 * -minus]
            out += [(a, positive, r + 1, k, -minus, -s) for r, (s, k, _) in enumerate(others[:5])]
    return out


def table(seed: int = 2, n: int = 700) -> list[tuple]:
    """Vectors around centres, with copies, ties, short, zero, null and non-finite ones, and repeated rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(9)] for _ in range(6)]
    rows = [
        (k, [rng.gauss(x, 0.2) for x in rng.choice(centres)], rng.choice([0, 1, 1, 1, 2, None]), 1, "x", "c", 2, 0.5)
        for k in range(n)
    ]
    rows += [(k, rows[k % 7][1], k % 3, 1, "x", "c", 2, 0.5) for k in range(n, n + 120)]
    odd = [None, [0.0] * 9, [0.5] * 4, [], [None] * 9, [float("nan")] * 9, [float("inf")] + [0.0] * 8, [-0.3] * 9]
    rows += [(k, odd[k % 8], k % 2, 1, "x", "c", 2, 0.5) for k in range(900, 924)]
    rows += [(-100, rows[5][1], 1, 1, "x", "c", 2, 0.5), (None, rows[5][1], 1, 1, "x", "c", 2, 0.5), (None,) * 8]
    rows += rows[:150] + [(100, rows[3][1], 2, 1, "x", "c", 2, 0.5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"wave_rows": 3}])
def test_negatives_equal_all_products(spark, options):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert ordered(hard_negatives(df, **options).collect()) == ordered(plain(rows))


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_intervals_hold_every_product(dim):
    rng = np.random.default_rng(dim)
    x = np.floor(256 * rng.standard_normal((300, dim)) * rng.uniform(0, 3, (300, 1))).astype(np.int64)
    x[:3] = 0
    x[3:9] = x[9:15]
    anchors = Anchors(np.arange(40), np.zeros(40, int), x[:40])
    low, high = anchors.intervals(np.arange(40), *encode(x))
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) < 2 * np.median(np.linalg.norm(x, axis=1)) ** 2


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(df).collect() == []
    df = spark.createDataFrame([(1, [0.5, 0.5], 1, 1, "", "", 1, 0.0)], SCHEMA)
    assert hard_negatives(df).collect() == []
