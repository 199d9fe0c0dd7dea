import random
from functools import cache

import pytest
from helpers import contamination, documents, empty, frame, ordered, sentence

from demandloom.llm.contamination import decontaminate, find_contamination

RNG = random.Random(3)
ITEMS = [(k, sentence(RNG, 30)) for k in range(8)] + [(8, "Short ITEM, five words"), (9, None), (10, "..."), (None, "no id"), (8, "twice")]


@cache
def planted():
    rows = documents(n=20)
    base = rows[0]
    for k, (item, text) in enumerate(ITEMS[:9]):
        rows.append((500 + k, f"{sentence(RNG, 10)} {text.upper()}, {sentence(RNG, 10)}", *base[2:]))
        rows.append((600 + k, f"{sentence(RNG, 4000)} {text} {sentence(RNG, 10)}", *base[2:]))
    return rows


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(spark, **kw):
    got = find_contamination(frame(spark, planted()), items(spark), **kw)
    return got, ordered(
        (r.doc_id, r.bench_words, r.bench_hit, r.bench_items, r.bench_contaminated) for r in got.collect()
    )


def test_equals_plain_python_in_one_block_and_in_many(spark):
    wanted = ordered(contamination(planted(), ITEMS))
    got, rows = found(spark)
    assert rows == wanted and set(frame(spark, []).columns) <= set(got.columns)
    assert found(spark, block_bytes=600)[1] == wanted


def test_documents_or_spans_are_removed(spark):
    wanted = {k: bad for k, _, _, _, bad in contamination(planted(), ITEMS)}
    left = decontaminate(frame(spark, planted()), items(spark))
    assert left.columns == frame(spark, []).columns
    assert {r.doc_id for r in left.collect()} == {k for k, bad in wanted.items() if not bad}
    cut = decontaminate(frame(spark, planted()), items(spark), action="spans").collect()
    before = {r[0]: r[1] for r in planted()}
    assert len(cut) == len(planted())
    for r in cut:
        if r.doc_id is not None:
            assert (r.text == before[r.doc_id]) != wanted[r.doc_id]
    assert not any(r.bench_hit for r in find_contamination(frame(spark, [tuple(r) for r in cut if wanted.get(r.doc_id)]), items(spark)).collect())


def test_empty_tables(spark):
    assert find_contamination(empty(spark), items(spark)).count() == 0
    clean = find_contamination(frame(spark, documents(n=5)), items(spark).limit(0)).collect()
    assert not any(r.bench_contaminated for r in clean)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_items_without_id_count_as_hits(spark, block_bytes):
    passage = sentence(random.Random(4), 20)
    rows = [(1, f"before {passage} after", "en", "s", 0, "", 0, ""), (2, "some other text", "en", "s", 0, "", 0, "")]
    items = spark.createDataFrame([(None, passage), (7, "unlike")], "item_id long, text string")
    got = find_contamination(frame(spark, rows), items, block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(r.bench_hit, r.bench_items, r.bench_contaminated) for r in got] == [(20, [], True), (0, [], False)]
