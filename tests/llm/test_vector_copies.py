"""Near copies among vectors against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ordered

from demandloom.llm.vector_copies import COUNTED, collisions, least_count, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell long, n_links string, raw string, copies int"


def plain(rows: list[tuple], threshold: float = 0.98) -> list[tuple]:
    live = [
        (k, key, np.array(v, np.float32).astype(float), label)
        for k, (key, v, label, *_) in enumerate(rows)
        if None not in (key, v, label) and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links, root = Counter(), list(range(len(rows)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for n, (i, a, u, mine) in enumerate(live):
        for j, b, v, label in live[:n]:
            if label == mine and len(u) == len(v) and u @ v >= threshold * np.linalg.norm(u) * np.linalg.norm(v):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, key, *_ in live:
        least[top(i)] = min(least.get(top(i), key), key)
    known = {i for i, *_ in live}
    found = [(r[0], links[k], least[top(k)] if k in known else r[0]) for k, r in enumerate(rows)]
    return [(*r, r[0] == r[2]) for r in found]


def table(seed: int = 4, groups: int = 25, dim: int = 24) -> list[tuple]:
    """Groups of near and exact copies of many sizes, one of hundreds, chains, labels and unusable vectors."""
    rng = random.Random(seed)
    rows: list[tuple] = []

    def put(v, label):
        rows.append((len(rows), v, label, 1, 2, "n", "r", 3))

    def near(v, angle):
        noise = [rng.gauss(0, 1) for _ in v]
        size = math.sqrt(sum(x * x for x in noise))
        return [x + angle * y / size for x, y in zip(v, noise, strict=True)]

    def unit():
        v = [rng.gauss(0, 1) for _ in range(dim)]
        return [x / math.sqrt(sum(y * y for y in v)) for x in v]

    for g in range(groups):
        centre = unit()
        for _ in range(400 if g == 0 else rng.choice([1, 1, 2, 5, 9])):
            put(near(centre, rng.choice([0.0, 0.05, 0.1, 0.3])), rng.choice([g % 3, g % 3, None, 7]))
    link = unit()
    for _ in range(12):
        link = near(link, 0.12)
        put(link, 1)
    for _ in range(300):
        put(unit(), 1)
    for v in [None, [], [0.0] * dim, [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [1e30] * dim, [1e-30] * dim, [3.0], [4.0]]:
        put(v, 0)
        put(v, 0)
    rows += [rows[5], (None, rows[5][1], 1, 1, 2, "n", "r", 3), (None,) * 8]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"block_rows": 40}])
def test_links_equal_all_pairs(spark, options):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got, want = ordered(near_vectors(df, **options).collect()), ordered(plain(rows))
    named = [r for r in want if r[0] is not None]
    assert [r for r in got if r[0] is not None] == named
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)] * 2


def test_count_loses_few_links_and_stops_the_rest():
    least = least_count()
    rng = np.random.default_rng(1)
    step = rng.standard_normal((200_000, COUNTED))
    assert ((np.abs(0.2 * step) <= 0.4).sum(axis=1) >= least).mean() > 1 - 1e-4
    assert ((np.abs(math.sqrt(2) * step) <= 0.4).sum(axis=1) >= least).mean() < 1e-4


def test_collisions_equal_all_differences():
    rng = np.random.default_rng(3)
    cluster = np.sort(rng.integers(0, 9, 120))
    places = rng.standard_normal((120, 7))
    places[5] = places[6]
    got = {(i, j): int(c) for i, j, c in zip(*(x.tolist() for x in collisions(cluster, places, 0.3)), strict=True)}
    want = {
        (i, j): n
        for i in range(120)
        for j in range(i + 1, 120)
        if cluster[i] == cluster[j] and (n := int((np.abs(places[i] - places[j]) <= 0.3).sum()))
    }
    assert got == want


def test_no_rows(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
