"""Small documents with every awkward case, and plain Python versions of the operators' results."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, node long, token string"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "si", "to", "vé") for b in ("ba", "du", "fe", "go", "hi", "x")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows with near and exact copies, empty, null, short and long texts, a repeated row and a null key."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    for _ in range(n):
        texts.append("\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(2, 8))))
    for k in range(0, n, 4):
        words = texts[k].split(" ")
        for edits in (1, 3, 8):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), texts[3], None, "", " \t\n ", "one", "one two", "One  TWO", "one two three"]
    texts += [sentence(rng, 30_000), "a" * 200_000, "#*$%&|<> " * 60]
    rows = [
        (k, x, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(x or ""), "kept", 7, "t")
        for k, x in enumerate(texts)
    ]
    rows += [rows[1], (None, texts[2], "en", "s1", 3, "kept", 7, "t"), (None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def measures(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def shingles(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().translate(bytes.maketrans(*(x.encode() for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))).split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def components(rows: list[tuple], width: int, up: int, down: int) -> list[tuple]:
    """(key, set size, component, links) of every row, from all pairs."""
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    root = list(range(len(sets)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    live = [k for k, (key, s) in enumerate(sets) if key is not None and s]
    for i, a in enumerate(live):
        for b in live[:i]:
            x, y = sets[a][1], sets[b][1]
            shared = len(x & y)
            if down * shared >= up * (len(x) + len(y) - shared):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least: dict[int, int] = {}
    for k in live:
        least[top(k)] = min(least.get(top(k), sets[k][0]), sets[k][0])
    known = set(live)
    return [
        (key, len(s), least[top(k)] if k in known else key, links[k] if k in known else 0)
        for k, (key, s) in enumerate(sets)
    ]


def contamination(rows: list[tuple], items: list[tuple], width: int = 13) -> list[tuple]:
    """(key, words, hit, items, contaminated) of every row."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = word.findall((text or "").translate(LETTERS))
        size = min(width, len(words))
        for k in range(len(words) - size + 1 if size and item is not None else 0):
            windows[tuple(words[k : k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for row in rows:
        words = word.findall((row[1] or "").translate(LETTERS))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= owners
        out.append((row[0], len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)


#: The hash constants that decide where chunks end.
BASE, STEP, MIXES, FULL = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (1 << 64) - 1


def scrambled(x: int, seed: int) -> int:
    x = (x + STEP * (seed + 1)) & FULL
    x = (x ^ (x >> 30)) * MIXES[0] & FULL
    x = (x ^ (x >> 27)) * MIXES[1] & FULL
    return x ^ (x >> 31)


def line_hash(raw: bytes) -> int:
    value, power = 0, 1
    for c in raw:
        value, power = (value + (c + 1) * power) & FULL, power * BASE & FULL
    return scrambled((value + len(raw) * MIXES[0]) & FULL, 0)


def line_runs(raw: bytes, long_line: int, window: int, divisor: int, min_words: int) -> tuple[list[tuple], set[tuple]]:
    """Lines with words as (start, end, words), and the (first, last) lines of chunks and windows."""
    lines, at = [], 0
    for line in raw.split(b"\n"):
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", line))
        if words:
            lines.append((at, at + len(line), words))
        at += len(line) + 1
    hashes, found, first = [line_hash(raw[a:b]) for a, b, _ in lines], set(), 0
    for k, (_, _, words) in enumerate(lines):
        rolling = 0
        for h in hashes[max(0, k - window + 1) : k + 1]:
            rolling = (rolling * BASE + h) & FULL
        ends = k + 1 >= window and scrambled(rolling, window) % divisor == 0
        if ends or words >= long_line or k + 1 == len(lines) or lines[k + 1][2] >= long_line:
            found.add((first, k))
            first = k + 1
    short = [words < long_line for _, _, words in lines]
    for k in range(len(lines)):
        for steps in (range(k, len(lines)), range(k, -1, -1)):
            total = 0
            for j in steps:
                total += lines[j][2]
                if total >= min_words:
                    low, high = min(k, j), max(k, j)
                    if any(short[low : high + 1]):
                        found.add((low, high))
                    break
    return lines, found


def without_repeats(rows: list[tuple], drop_emptied: bool = False, min_words: int = 40) -> list[tuple]:
    """(row with its text cut, runs removed, words removed) of every row, from all chunks and windows."""
    cut = {r[0]: (raw := (r[1] or "").encode(), *line_runs(raw, 12, 2, 3, min_words)) for r in rows if r[0] is not None}
    places = defaultdict(list)
    for key, (raw, lines, found) in cut.items():
        for low, high in found:
            places[raw[lines[low][0] : lines[high][1]]].append((key, low, high))
    repeated = defaultdict(list)
    for owners in places.values():
        key, low, high = min(owners)
        for k, a, b in owners:
            if not (k == key and a < low + b + 1 - a):
                repeated[k].append((a, b))
    out = []
    for r in rows:
        raw, lines, _ = cut.get(r[0], (b"", [], None))
        islands: list[list[int]] = []
        for a, b in sorted(set(repeated[r[0]])):
            if islands and a <= islands[-1][1] + 1:
                islands[-1][1] = max(islands[-1][1], b)
            else:
                islands.append([a, b])
        sizes = [(a, b, sum(words for _, _, words in lines[a : b + 1])) for a, b in islands]
        gone = [x for x in sizes if x[2] >= min_words]
        text = raw
        for a, b, _ in reversed(gone):
            end = lines[b][1]
            text = text[: lines[a][0]] + text[end + (raw[end : end + 1] == b"\n") :]
        if not (drop_emptied and gone and not re.search(rb"[^\x20\x09-\x0D]", text)):
            new = text.decode() if gone else r[1]
            out.append(((r[0], new, *r[2:]), len(gone), sum(x[2] for x in gone)))
    return out
