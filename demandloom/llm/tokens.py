"""Token ids of many texts at once with a public tokenizer, by a cache over the texts' words.

The ids are those of `tokenizers` with the given file. Where the same vocabulary lies beside it as
ranks, words of common characters are looked up through them, which is faster and gives the same ids.

Under byte-level BPE a space that stands before a visible character always begins a new pre-token, so
a text may be cut there and its parts encoded apart without changing any id.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Parts kept in the cache; it starts anew beyond that. Longer parts than LONGEST are not kept.
CACHE_PARTS = 400_000
LONGEST = 48

#: Where a text may be cut: a space before a visible character begins a pre-token, whatever stands before.
_ODD = re.compile(r" (?![\w!-~])")
_CUT = re.compile(r" (?=[\w!-~])")
#: Parts of these characters go through the faster library; both have one vocabulary and agree on them.
_PLAIN = re.compile(r"[!-~\u00a1-\u024f]+")
_USUAL = re.compile(r"[\t\n\r -~\u00a1-\u024f]+")
#: Parts that are encoded as one text.
_AT_ONCE = 100_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranked(path: str):
    """The vocabulary as ranks, beside the file `path`, for the faster library."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. Made in the task that uses it."""

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or tokenizer_path())
        self.model.encode_special_tokens = True
        ranks = os.path.splitext(path or tokenizer_path())[0] + ".tiktoken"
        self.fast = ranked(ranks) if os.path.exists(ranks) else None
        self.after: dict[str, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part with a space before it.

        Parts without white space are encoded as one text, a line break after each: a break before a
        space is a pre-token of its own, and its id marks the end of a part.
        """
        if self.fast is None:
            return self.raw([f" {x}" for x in parts])
        out: dict[str, bytes] = {}
        mark = self.fast.encode_ordinary("\n")[0]
        plain = [x for x in parts if _PLAIN.fullmatch(x)]
        for low in range(0, len(plain), _AT_ONCE):
            some = plain[low : low + _AT_ONCE]
            line = "".join([f" {x}\n" for x in some])
            ids = np.array(self.fast.encode_ordinary(line), dtype="<u4")
            stops = np.flatnonzero(ids == mark)
            if len(stops) != len(some):
                raise AssertionError("a part's ids hold the mark")
            raw = ids.tobytes()
            starts = np.concatenate([[0], stops[:-1] + 1])
            out.update(
                (x, raw[a:b]) for x, a, b in zip(some, (4 * starts).tolist(), (4 * stops).tolist(), strict=True)
            )
        rest = []
        for x in parts:
            if x not in out:
                if len(x) <= LONGEST and _USUAL.fullmatch(x):
                    out[x] = np.array(self.fast.encode_ordinary(f" {x}"), dtype="<u4").tobytes()
                else:
                    rest.append(x)
        out.update(zip(rest, self.raw([f" {x}" for x in rest]), strict=True))
        return [out[x] for x in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        if len(self.after) > CACHE_PARTS:
            self.after.clear()
        parts = [_CUT.split(x) if _ODD.search(x) else x.split(" ") for x in (t or "" for t in texts)]
        first = list({p[0] for p in parts if p[0]})
        head_of = {"": b""} | dict(zip(first, self.raw(first), strict=True))
        missing: set[str] = set()
        for p in parts:
            missing.update(p[1:])
        missing -= self.after.keys()
        new = list(missing)
        self.after.update(zip(new, self.parts(new), strict=True))
        get = self.after.__getitem__
        out = [head_of[p[0]] + b"".join(map(get, p[1:])) for p in parts]
        for x in new:
            if len(x) > LONGEST:
                del self.after[x]
        return out
