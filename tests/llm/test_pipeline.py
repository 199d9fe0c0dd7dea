"""The whole pipeline, and each stage on its own input, against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import components, contamination, documents, measures, sentence, without_repeats

import corpus_pipeline as P
from demandloom.llm.tokens import Encoder

ITEMS = [(k, sentence(random.Random(11 + k), 40)) for k in range(6)]


def table():
    rng = random.Random(17)
    seen = {}
    for r in documents(seed=4, n=40):
        if r[0] is not None:
            seen.setdefault(r[0], r[:5])
    passage = "\n".join(sentence(rng, 25) for _ in range(3))
    rows = list(seen.values())
    for k in range(6):
        item = ITEMS[k][1] if k < 3 else ""
        rows.append((500 + k, f"{sentence(rng, 60)}\n{passage}\n{sentence(rng, 60)} {item}", "en", "s1", 0))
    return sorted(rows)


ROWS = table()


def stages(rows):
    yield (rows := [r for r in rows if not measures(r[1])[-1]])
    yield (rows := [r for r, _, _ in without_repeats(rows, drop_emptied=True)])
    found = {k: c for k, _, c, _ in components(rows, 5, 4, 5)}
    yield (rows := [r for r in rows if found[r[0]] == r[0]])
    bad = {k for k, *_, bad in contamination(rows, ITEMS) if bad}
    yield [r for r in rows if r[0] not in bad]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def packed(rows):
    texts = {r[0]: r[1] for r in rows}
    return dict(zip(texts, [x + b"\0\0\0\0" for x in Encoder().raw(list(texts.values()))]))


def check_pieces(got, wanted):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(wanted)
    for key, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(wanted[key][4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(wanted[key])


def test_each_stage_on_what_the_last_one_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, len(ROWS)
    for (name, stage), wanted in zip(P.STAGES, stages(ROWS)):
        docs = P.staged(stage(spark, docs, folder), "stage")
        assert docs.columns == columns, name
        assert Counter(tuple(r) for r in docs.collect()) == Counter(wanted), name
        assert 0 < len(wanted) < kept or name == "line dedup"
        kept = len(wanted)


def test_run_equals_plain_python(spark, folder):
    *_, last = stages(ROWS)
    check_pieces(P.run(spark, folder).collect(), packed(last))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
