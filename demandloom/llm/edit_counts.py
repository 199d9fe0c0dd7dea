"""Token counts that follow edits: each document keeps a segment tree over leaves of whole pre-tokens.

A leaf is a stretch of text between two places where a pre-token surely begins; a node holds the
characters and tokens below it. An edit is located by descending the tree. Only the leaves it touches
are encoded again, with the leaf before them if their first boundary is gone, and the sums above them
are updated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import _CUT, Encoder
from .words import pieces

LEAF_CHARS = 256

EDITS = T.ArrayType(
    T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("text", T.StringType())])
)

#: What a masking pass replaces: mail addresses and long runs of digits with their separators.
MASKS = (
    (re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+[A-Za-z0-9]"), "<mail>"),
    (re.compile(r"(?<![\w+])\+?\d(?:[ ().-]{0,2}\d){6,}"), "<number>"),
)


def leaves_of(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text cut before spaces that begin a pre-token, each part at least `size` long but the last."""
    out, at = [], 0
    while found := _CUT.search(text, at + size):
        out.append(text[at : found.start()])
        at = found.start()
    return out + [text[at:]]


class Tree:
    """Sums of characters and tokens: node k has children 2k and 2k + 1, and leaves come last."""

    def __init__(self, sums: np.ndarray) -> None:
        self.sums, self.width = sums, len(sums) // 2

    @classmethod
    def build(cls, chars: list[int], tokens: list[int]) -> Tree:
        width = 1 << max(0, len(chars) - 1).bit_length()
        sums = np.zeros((2 * width, 2), np.int64)
        sums[width : width + len(chars), 0] = chars
        sums[width : width + len(chars), 1] = tokens
        level = width
        while level > 1:
            half = level // 2
            sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half
        return cls(sums)

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        return cls(np.frombuffer(raw, "<i8").reshape(-1, 2).copy())

    def dump(self) -> bytes:
        return self.sums.astype("<i8").tobytes()

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds the character at `char` (the last one with text, beyond the end), and its start."""
        char = min(char, int(self.sums[1, 0]) - 1)
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char - start >= self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def sound(edits: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, str]]:
    """Edits in order, each once; those that overlap an earlier one or leave the text are refused."""
    out, end, last = [], 0, None
    for low, high, new in sorted(set(edits)):
        if low < 0 or high < low or high > length or low < end or (low, high) == last:
            continue
        out.append((low, high, new))
        end, last = high, (low, high)
    return out


class Suffix:
    """The edited end of a text: the text up to `begin`, then pieces, of which the last is the first."""

    def __init__(self, text: str) -> None:
        self.text, self.begin, self.pieces = text, len(text), []

    def take(self, low: int, high: int) -> str:
        """Cuts off what now lies from `low` to `high`; the pieces begin after it. Up to `low` nothing has changed."""
        if self.begin < low:
            self._cut(low - self.begin)
        else:
            self.pieces.append(self.text[low : self.begin])
        return self._cut(high - low)

    def _cut(self, chars: int) -> str:
        out = []
        while chars > 0 and self.pieces:
            piece = self.pieces.pop()
            if len(piece) > chars:
                self.pieces.append(piece[chars:])
                piece = piece[:chars]
            out.append(piece)
            chars -= len(piece)
        return "".join(out)

    def put(self, piece: str, begin: int) -> None:
        self.pieces.append(piece)
        self.begin = begin

    def whole(self) -> str:
        return self.text[: self.begin] + "".join(reversed(self.pieces))


def edited(text: str, tree: Tree, edits: list[tuple[int, int, str]], encode) -> tuple[str, int]:
    """Applies sound edits, last first, to the text and its tree; returns the text and how many leaves were encoded.

    The parts that are left and those that are new are joined once, so the time is that of the text and
    of the leaves that edits touch.
    """
    again, end = 0, Suffix(text)
    for low, high, new in reversed(edits):
        first, start = tree.find(low)
        last, begin = tree.find(max(low, high - 1))
        stop = begin + int(tree.sums[tree.width + last, 0])
        part = text[start:low] + new + end.take(high, stop)
        # Boundary context: without a sure beginning the part may join with what stands before it.
        while start > 0 and not _CUT.match(part):
            first, before = tree.find(start - 1)
            part, start = text[before:start] + part, before
        slots = last - first + 1
        leaves = leaves_of(part)
        if len(leaves) > slots:
            leaves[slots - 1 :] = ["".join(leaves[slots - 1 :])]
        leaves += [""] * (slots - len(leaves))
        for k, (leaf, ids) in enumerate(zip(leaves, encode(leaves), strict=True)):
            tree.put(first + k, len(leaf), len(ids) // 4)
        end.put(part, start)
        again += slots
    return end.whole(), again


def with_trees(docs: DataFrame, text: str = "text", tree: str = "tree", tokens: str = "n_tokens") -> DataFrame:
    """`docs` with the segment tree of each text and its token count (columns of these names are replaced).

    A null text counts as an empty one: no tokens. The tree is binary, 16 bytes a node.
    """
    frame = docs.drop(tree, tokens)
    names = frame.columns
    schema = T.StructType([*frame.schema.fields, T.StructField(tree, T.BinaryType()), T.StructField(tokens, T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in pieces(batches, text):
            cut = [leaves_of(x or "") for x in batch.column(text).to_pylist()]
            sizes = iter([len(ids) // 4 for ids in encoder.encode([leaf for leaves in cut for leaf in leaves])])
            trees = [Tree.build([len(x) for x in leaves], [next(sizes) for _ in leaves]) for leaves in cut]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array([t.dump() for t in trees], pa.binary()),
                    pa.array([t.tokens for t in trees], pa.int64()),
                ],
                names=[*names, tree, tokens],
            )

    return frame.mapInArrow(scan, schema)


def apply_edits(
    frame: DataFrame,
    edits: str = "edits",
    text: str = "text",
    tree: str = "tree",
    tokens: str = "n_tokens",
    counts: str = "edit_",
) -> DataFrame:
    """Rows of `with_trees` after their `edits`, an array of (low, high, text) in characters of the old text.

    `text`, `tree` and `tokens` are those of the edited text; `<counts>applied`, `<counts>leaves` and
    `<counts>encoded` are added. Repeated edits count once; of edits that overlap, the first in order
    holds, and edits that leave the text are refused. Null or no edits leave a row as it is; a null text stays
    null unless it is edited.
    """
    added = [f"{counts}applied", f"{counts}leaves", f"{counts}encoded"]
    base = frame.drop(*added)
    names = base.columns
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in pieces(batches, text):
            texts, trees = batch.column(text).to_pylist(), batch.column(tree).to_pylist()
            totals = batch.column(tokens).to_pylist()
            applied, leaves, encoded = [], [], []
            for k, wanted in enumerate(batch.column(edits).to_pylist()):
                nodes = len(trees[k]) // 32
                old = texts[k] or ""
                todo = sound([(e["low"], e["high"], e["text"] or "") for e in wanted or ()], len(old))
                again = 0
                if todo:
                    own = Tree.load(trees[k])
                    texts[k], again = edited(old, own, todo, encoder.encode)
                    trees[k], totals[k] = own.dump(), own.tokens
                applied.append(len(todo))
                leaves.append(nodes)
                encoded.append(again)
            new = {text: pa.array(texts, pa.string()), tree: pa.array(trees, pa.binary()), tokens: pa.array(totals, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [*(new.get(c, batch.column(c)) for c in names), *(pa.array(x, pa.int64()) for x in (applied, leaves, encoded))],
                names=[*names, *added],
            )

    return base.mapInArrow(scan, schema)


def mask_edits(docs: DataFrame, text: str = "text", edits: str = "edits") -> DataFrame:
    """`docs` with the edits that mask mail addresses and numbers in each text (null: none)."""
    frame = docs.drop(edits)
    names = frame.columns
    schema = T.StructType([*frame.schema.fields, T.StructField(edits, EDITS)])
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("text", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = [
                [
                    {"low": m.start(), "high": m.end(), "text": mask}
                    for pattern, mask in MASKS
                    for m in pattern.finditer(x or "")
                ]
                for x in batch.column(text).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found, kind)], names=[*names, edits]
            )

    return frame.mapInArrow(scan, schema)


def masked_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each document before and after masking, and how much was encoded again."""
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    before = mask_edits(with_trees(rows)).withColumn("n_tokens_before", F.col("n_tokens"))
    return apply_edits(before).select(
        key,
        "n_tokens_before",
        F.col("n_tokens").alias("n_tokens_after"),
        F.col("edit_applied").alias("n_edits"),
        F.col("edit_leaves").alias("n_leaves"),
        F.col("edit_encoded").alias("n_encoded"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
