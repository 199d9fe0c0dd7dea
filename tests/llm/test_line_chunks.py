import random
from collections import Counter

import numpy as np
from helpers import documents, empty, frame, ordered, sentence, without_repeats
from pyspark.sql import functions as F

from demandloom.llm.line_chunks import chunk_spans, dedup_lines


def test_every_planted_passage_stays_once_and_other_lines_stay(spark):
    rng = random.Random(5)
    passages = ["\n".join(sentence(rng, 20) for _ in range(3)) for _ in range(5)] + [sentence(rng, 51)]
    rows = []
    for k in range(80):
        lines = [f"{sentence(rng, 15)} {k}" for _ in range(4)]
        if k % 3 == 0:
            lines.insert(rng.randint(0, 4), rng.choice(passages))
        rows.append((k, "\n".join(lines), "en", "s", 0, "", 0, ""))
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    for p in passages:
        owners = [r[0] for r in rows if p in r[1]]
        assert [k for k in sorted(got) if p in got[k]] == owners[:1]
    for key, text, *_ in rows:
        own = [x for x in text.split("\n") if not any(x in p for p in passages)]
        assert [x for x in got[key].split("\n") if x and not any(x in p for p in passages)] == own


def test_whole_passages_of_short_lines_go(spark):
    rng = random.Random(9)
    rows, passages = [], {}
    for lines, width in [(11, 5), (5, 11), (6, 10), (8, 7), (10, 8), (10, 10)] * 5:
        passage = "\n".join(sentence(rng, width) for _ in range(lines))
        for _ in range(3):
            own = [f"{sentence(rng, rng.randint(1, 8))} {len(rows)}.{k}" for k in range(8)]
            passages[len(rows)] = (passage, own)
            rows.append((len(rows), "\n".join([*own[:4], passage, *own[4:]]), "en", "s", 0, "", 0, ""))
    got = {r.doc_id: r for r in dedup_lines(frame(spark, rows), counts="removed_").collect()}
    for key, text, *_ in rows:
        passage, own = passages[key]
        if key % 3 == 0:
            assert (got[key].text, got[key].removed_words) == (text, 0)
        else:
            assert got[key].text == "\n".join(own)
            assert (got[key].removed_runs, got[key].removed_words) == (1, len(passage.split()))


def test_copies_that_overlap_their_first_occurrence_stay(spark):
    rows = [(1, "\n".join(["same"] * 100), "en", "s", 0, "", 0, "")]
    left = dedup_lines(frame(spark, rows)).first().text
    assert 40 <= left.count("same") < 80


def test_short_repeated_lines_stay(spark):
    rows = [(k, f"unlike line {k} of this text\nAll rights reserved.\nend {k}", "en", "s", 0, "", 0, "") for k in range(20)]
    assert ordered(dedup_lines(frame(spark, rows)).collect()) == ordered(rows)


def test_awkward_rows(spark):
    rows = documents()
    done = dedup_lines(frame(spark, rows), counts="removed_")
    assert done.columns[: len(rows[0])] == frame(spark, rows).columns
    got = done.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    before = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is None or not r.removed_runs:
            assert r.text == before[r.doc_id] or r.doc_id is None
        else:
            assert r.removed_words >= 40 and len(r.text) < len(before[r.doc_id])
    # An exact copy loses all, its first occurrence nothing; emptied rows can be left out.
    assert any(r.removed_runs and not r.text.strip() for r in got)
    left = dedup_lines(frame(spark, rows), drop_emptied=True).collect()
    assert {r.doc_id for r in left} == {r.doc_id for r in got if not (r.removed_runs and not r.text.strip())}
    assert dedup_lines(empty(spark)).count() == 0


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    lines = [sentence(rng, rng.randint(1, 6)) for _ in range(200)]

    def chunks(text: str) -> list[bytes]:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _, _ = chunk_spans(data, np.array([0, len(raw)]), 12, 2, 3)
        return [raw[a:b] for a, b in zip(starts, ends)]

    whole, shifted = chunks("\n".join(lines)), chunks("\n".join(["new first line", *lines[5:]]))
    assert len(set(shifted) - set(whole)) <= 2
    assert max(c.count(b"\n") for c in whole) >= 2


def passages_among_lines(seed: int) -> list[tuple]:
    """Texts of short and long lines with shared passages, some overlapping, copies and repeats within a text."""
    rng = random.Random(seed)
    stock = ["\n".join(sentence(rng, rng.randint(1, 18)) for _ in range(rng.randint(2, 14))) for _ in range(6)]
    rows = documents(seed, 16)
    for k in range(40):
        lines = [sentence(rng, rng.randint(1, 20)) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            part = rng.choice(stock).split("\n")
            low = rng.randrange(len(part))
            lines[rng.randint(0, len(lines)) :] = part[low:] if rng.random() < 0.3 else part
        rows.append((1000 + k, "\n".join(lines) + rng.choice(["", "\n", " \n\n"]), "en", "s", 0, "kept", 7, "t"))
    return rows


def test_equals_plain_python(spark):
    for seed in (1, 2):
        rows = passages_among_lines(seed)
        got = ordered(dedup_lines(frame(spark, rows).withColumn("removed_runs", F.lit("old")), counts="removed_").collect())
        assert got == ordered([(*r, n, words) for r, n, words in without_repeats(rows)])
        left = ordered(dedup_lines(frame(spark, rows), drop_emptied=True).collect())
        assert left == ordered([r for r, _, _ in without_repeats(rows, drop_emptied=True)])
