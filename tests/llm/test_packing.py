import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import documents, empty, frame

from demandloom.llm.packing import pack
from demandloom.llm.tokens import Encoder

ODD = ["a  b", " a", "a ", "\n\n b", "x\r\n y", "it's  we'll", "日本 語", "a b c", "a 　b", "<|endoftext|> a", "é è", "1 2\t3", "a \n b", "\x1c a \x1d b", "ẞ Ⅷ ½ x²"]


def whole(texts):
    return [np.frombuffer(x, "<u4") for x in Encoder().raw([t or "" for t in texts])]


def test_cached_ids_equal_those_of_whole_texts():
    texts = [*ODD, *(r[1] for r in documents(n=20))]
    got = Encoder().encode(texts)
    assert all(a == b.tobytes() for a, b in zip(got, whole(texts), strict=True))


@pytest.mark.parametrize(("length", "windows"), [(1024, 64), (64, 3)])
def test_every_id_lies_in_one_piece(spark, length, windows):
    rows = documents(n=40) + [(700 + k, x, "en", "s", 0, "", 0, "") for k, x in enumerate(ODD)]
    got = pack(frame(spark, rows), length=length, open_windows=windows).collect()
    wanted = defaultdict(list)
    for (key, *_), ids in zip(rows, whole(r[1] for r in rows), strict=True):
        wanted[key].append(tuple([*ids.tolist(), 0]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (key, total), found in pieces.items():
        same = [w for w in wanted[key] if len(w) == total]
        starts = [s for s, _ in found]
        if len(same) == 1:
            raw = b"".join(ids for _, ids in sorted(found))
            assert tuple(np.frombuffer(raw, "<u4").tolist()) == same[0]
        assert len(starts) == len(same) * len(set(starts))
    assert {(k, len(w)) for k, ws in wanted.items() for w in ws} == set(pieces)
    padding = used = 0
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= length
        used += at
        padding += length - at
    assert padding < 0.1 * used + length


def test_empty_table_and_checksum(spark):
    assert pack(empty(spark)).count() == 0
    (row,) = pack(frame(spark, [(1, None, "", "", 0, "", 0, "")])).collect()
    assert zlib.crc32(row.ids) == zlib.crc32(b"\0\0\0\0") and row.doc_tokens == 1
