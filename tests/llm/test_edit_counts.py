import random

from helpers import documents, empty, frame
from pyspark.sql import functions as F

from demandloom.llm import edit_counts
from demandloom.llm.edit_counts import LEAF_CHARS, Tree, apply_edits, edited, leaves_of, mask_edits, sound, with_trees
from demandloom.llm.tokens import Encoder

PARTS = ["a", "bc", " ", "  ", "\n", "é", "ñ9", "12", "'s", ".", "!?", " \n", "the ", " cat", "日本", "x" * 30]


def test_any_edits_give_the_count_of_the_new_text():
    rng, encoder = random.Random(3), Encoder()

    def full(x):
        return len(encoder.raw([x])[0]) // 4

    for _ in range(400):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 300)))
        leaves = leaves_of(text, rng.choice([8, LEAF_CHARS]))
        tree = Tree.build([len(x) for x in leaves], [full(x) for x in leaves])
        edits = []
        for _ in range(rng.randint(0, 5)):
            low = rng.randint(0, len(text))
            edits.append((low, min(len(text), low + rng.choice([0, 1, 3, 40])), "".join(rng.choices(PARTS, k=rng.choice([0, 1, 40])))))
        edits = sound(edits, len(text))
        wanted = text
        for low, high, new in reversed(edits):
            wanted = wanted[:low] + new + wanted[high:]
        got, _ = edited(text, tree, edits, encoder.encode)
        assert (got, tree.tokens, int(tree.sums[1, 0])) == (wanted, full(wanted), len(wanted))


def test_only_touched_leaves_are_encoded():
    encoder = Encoder()
    text = " ".join(f"word{k}" for k in range(20_000))
    leaves = leaves_of(text)
    tree = Tree.build([len(x) for x in leaves], [len(x) // 4 for x in encoder.encode(leaves)])
    _, again = edited(text, tree, [(70_000, 70_004, "W")], encoder.encode)
    assert len(leaves) > 500 and again <= 2


def test_rows(spark):
    rows = documents(n=12) + [(800, "write to me.you@mail.example now, or call +49 (30) 1234567", "", "", 0, "", 0, "")]
    trees = with_trees(frame(spark, rows).withColumn("tree", F.lit(1)))
    got = apply_edits(mask_edits(trees)).collect()
    encoder = Encoder()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(encoder.raw([r.text or ""])[0]) // 4
        if r.doc_id == 800:
            assert r.text == "write to <mail> now, or call <number>" and r.edit_applied == 2
    none = apply_edits(trees.withColumn("edits", F.lit(None).cast("array<struct<low:bigint,high:bigint,text:string>>")))
    assert all(r.edit_encoded == 0 for r in none.collect())
    assert apply_edits(mask_edits(with_trees(empty(spark)))).count() == 0


def test_refused_edits():
    assert sound([(3, 2, ""), (-1, 2, ""), (0, 9, ""), (1, 3, "a"), (1, 3, "a"), (2, 4, "b"), (3, 3, "c")], 5) == [(1, 3, "a"), (3, 3, "c")]


def test_many_edits_take_the_time_of_the_text():
    """Twice the text with twice the edits moves about twice the characters."""
    def moved(n):
        text = "ab " * n
        leaves = leaves_of(text)
        tree = Tree.build([len(x) for x in leaves], [1] * len(leaves))
        seen = []
        edits = [(k, k + 1, "c") for k in range(0, len(text), 30)]

        class Counted(edit_counts.Suffix):
            def take(self, low, high):
                out = super().take(low, high)
                seen.append(len(out) + len(self.pieces[-1] if self.pieces else ""))
                return out

        edit_counts.Suffix, real = Counted, edit_counts.Suffix
        try:
            got, _ = edited(text, tree, edits, lambda leaves: [b"1234"] * len(leaves))
        finally:
            edit_counts.Suffix = real
        assert got == "".join("c" if k % 30 == 0 else x for k, x in enumerate(text))
        return sum(seen)

    assert moved(40_000) < 3 * moved(20_000)
