"""All pairs of titles that are alike by spelling, words in order, whether they share a word or not.

Edits that are spread evenly leave no word, and no few letters, that two such titles must share, so no index finds them
all. Titles of near lengths are compared in tiles instead, each of two bounded parts of two neighbouring bands of lengths,
by bounds that never lose a pair:

1. Lengths, and counts of characters by class: what stands in one title alone is at least their difference.
2. The longest common subsequence of what the titles don't share, for two classes of characters at a time. What one class
   has in one title alone adds up over the classes, and the bits of a class fit a word or few, so a title is compared
   with all that are left of a part at once.

What is left is compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of characters, and pairs of classes, the most frequent first, that the second bound takes.
CLASSES, GROUPS = 32, 6
#: Titles and characters of a part, at most but for how hashes fall.
PART_TITLES, PART_CHARS = 12_000, 6_000_000
#: Pairs that the second bound takes at a time, times the characters of a title.
BATCH = 4_000_000
#: Below so many pairs for each word of bits, titles are compared in full at once.
FEW = 6
#: Pairs of titles for each task that tiles are dealt to, and tasks at most.
PAIRS, TASKS = 200_000, 2_000


class Part:
    """Titles, as their distinct words in order, sorted by length."""

    def __init__(self, ids: np.ndarray, texts: list[str], numbers: dict[str, int]):
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(n, kind="stable")
        self.ids, self.n, self.texts = ids[order], n[order], [texts[i] for i in order]
        words = [t.split(" ") for t in self.texts]
        flat = [w for ws in words for w in ws]
        self.words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in flat), np.int32, len(flat))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.word_ends = np.concatenate([[0], np.cumsum(sizes)])
        within = np.arange(len(flat)) - np.repeat(self.word_ends[:-1], sizes)
        # the last word number is that of no word
        self.table = np.full((len(texts), int(sizes.max(initial=0))), -1, np.int32)
        self.table[np.repeat(np.arange(len(texts)), sizes), within] = self.words
        # each title ends in a blank, as each word does
        every = np.frombuffer("".join(t + " " for t in self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = (every % CLASSES).astype(np.uint8)
        self.rows = np.repeat(np.arange(len(texts), dtype=np.int32), self.n + 1)
        self.of = np.repeat(within.astype(np.int32), np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
        counts = np.bincount(self.rows * np.int64(CLASSES) + self.codes, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
        self.counts = np.ascontiguousarray(np.minimum(counts, 16_000).astype(np.int16).T)
        self.classes = np.argsort(-counts.sum(axis=0), kind="stable")[: 2 * GROUPS]
        self.groups: dict[int, tuple] = {}

    def group(self, g: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each title its characters of two classes in order, as 1 and 2, with the places of their words; and how many."""
        if g not in self.groups:
            letter = np.zeros(CLASSES, np.uint8)
            letter[classes[2 * g : 2 * g + 2]] = (1, 2)
            at = np.flatnonzero(letter[self.codes])
            rows = self.rows[at]
            n = np.bincount(rows, minlength=len(self.texts))
            place = np.arange(len(at)) - (np.cumsum(n) - n)[rows]
            width = 64 * _words_of_bits(n)
            letters, of = np.zeros((len(n), width), np.uint8), np.zeros((len(n), width), np.int32)
            letters[rows, place], of[rows, place] = letter[self.codes[at]], self.of[at]
            self.groups[g] = letters, of, n
        return self.groups[g]

    def near(self, n: int, counts: np.ndarray, low: int, spare: float) -> np.ndarray:
        """Titles from low on that a title of n characters, with these counts of classes, may be alike."""
        low = max(low, int(np.searchsorted(self.n, n * (1 - spare) / (1 + spare) - 1e-6)))
        high = int(np.searchsorted(self.n, n * (1 + spare) / (1 - spare) + 1e-6, side="right"))
        if low >= high:
            return np.empty(0, np.int64)
        apart = np.zeros(high - low, np.int16 if n < 8_000 else np.int32)
        for c in range(CLASSES):
            apart += np.abs(self.counts[c, low:high] - counts[c])
        return low + np.flatnonzero(apart <= spare * (n + self.n[low:high]) + 1e-6)


def _words_of_bits(sizes: np.ndarray) -> int:
    return max(1, -(-int(sizes.max(initial=0)) // 64))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as words of 64, one row of the result for each word."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").T


def _common(masks: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs: steps, the letters 1 and 2 of one side, 0 for none, a row for
    each place; masks, where the other side has each letter, as words of bits of pairs."""
    _, size, n = masks.shape
    flat = [np.ascontiguousarray(masks[:, b]).ravel() for b in range(size)]
    base = np.arange(n)
    state, step, at = np.full((size, n), 0xFFFFFFFFFFFFFFFF, np.uint64), np.empty((size, n), np.uint64), np.empty(n, np.int64)
    for letters in steps:
        # one row of the table of common subsequences, of all pairs at once
        np.multiply(letters, n, out=at, casting="unsafe", dtype=np.int64)
        at += base
        for b in range(size):
            np.take(flat[b], at, out=step[b], mode="clip")
        step &= state
        total = state + step
        state ^= step
        if size > 1:
            over = total[0] < step[0]
            for b in range(1, size):
                more = total[b] < step[b]
                total[b] += over
                over = more | (over & (total[b] == 0))
        state |= total
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def _shared(x: Part, y: Part, i: np.ndarray, j: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of titles i of x stand in j of y, and the other way round. known: a 0 for each word, and one more."""
    in_x, in_y = np.zeros((len(i), x.table.shape[1]), bool), np.zeros((len(j), y.table.shape[1]), bool)
    edges = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        words = x.words[x.word_ends[i[low]] : x.word_ends[i[low] + 1]]
        known[words] = np.arange(1, len(words) + 1)
        place = known[y.table[j[low:high]]]
        known[words] = 0
        in_y[low:high] = place > 0
        pairs, columns = np.nonzero(place)
        in_x[low + pairs, place[pairs, columns] - 1] = True
    return in_x, in_y


def _survivors(x: Part, y: Part, i: np.ndarray, j: np.ndarray, known: np.ndarray, spare: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of titles i of x, which are in order, and j of y that the second bound leaves."""
    if len(i) < FEW:
        return i, j
    room, lost = spare * (x.n[i] + y.n[j]) + 1e-6, np.zeros(len(i), np.int64)
    in_x, in_y = _shared(x, y, i, j, known)
    for g in range(len(y.classes) // 2):
        (x_letters, x_of, x_n), (y_letters, y_of, y_n) = x.group(g, y.classes), y.group(g, y.classes)
        size, longest = _words_of_bits(y_n[j]), int(x_n[i].max(initial=0))
        if len(i) < FEW * size:
            break
        left = x_letters[i, :longest] * ~np.take_along_axis(in_x, x_of[i, :longest], axis=1)
        right = y_letters[j, : 64 * size] * ~np.take_along_axis(in_y, y_of[j, : 64 * size], axis=1)
        masks = np.zeros((3, size, len(i)), np.uint64)
        masks[1], masks[2] = _packed(right == 1), _packed(right == 2)
        lost += np.count_nonzero(left, axis=1) + np.count_nonzero(right, axis=1) - 2 * _common(masks, np.ascontiguousarray(left.T))
        kept = lost <= room
        i, j, room, lost, in_x, in_y = (z[kept] for z in (i, j, room, lost, in_x, in_y))
    return i, j


def alike_in_tile(x: Part, y: Part, words: int, threshold: float, similarity: Callable[[str, str, float], float]) -> tuple[list[int], list[int], list[float]]:
    """ids and scores of pairs of x and y, or of pairs within x if y is x, whose lengths are near and that are alike.
    words: how many different ones there are."""
    spare = 1 - threshold / 100
    known = np.zeros(words + 1, np.int32)
    out = [], [], []
    if not len(y.texts):
        return out
    met, waiting = [], 0
    for i in range(len(x.texts)):
        found = y.near(int(x.n[i]), x.counts[:, i], i + 1 if x is y else 0, spare)
        met.append(found)
        waiting += len(found)
        if waiting * (x.n[i] + 1) < BATCH and i < len(x.texts) - 1:
            continue
        left = np.repeat(np.arange(i + 1 - len(met), i + 1), [len(f) for f in met])
        right = np.concatenate(met)
        most = max(1, BATCH // int(x.n[i] + 1))
        for at in range(0, len(left), most):
            for a, b in zip(*(z.tolist() for z in _survivors(x, y, left[at : at + most], right[at : at + most], known, spare)), strict=True):
                score = similarity(x.texts[a], y.texts[b], threshold)
                if score >= threshold:
                    for column, value in zip(out, (x.ids[a], y.ids[b], score), strict=True):
                        column.append(value)
        met, waiting = [], 0
    return out


def near_titles(left: DataFrame, right: DataFrame | None, threshold: float, similarity: Callable[[str, str, float], float]) -> DataFrame:
    """x, y, score: all pairs of titles (k, every: its distinct words in order, n: their length; own: what both must have
    equal) of left and right of which a common subsequence makes them alike, and may be others that are alike. Without
    right, pairs within left, each once."""
    spare = 1 - threshold / 100
    wide = math.log((1 + spare) / (1 - spare) * 1.0001)  # lengths that near go into one band or the next
    band = F.floor(F.log("n") / wide).cast("int").alias("band")
    banded = [s.where("n > 0").select("k", "every", "n", F.col("own") if "own" in s.columns else F.lit(0).cast("long").alias("own"), band) for s in (left, right) if s is not None]

    # a row for each band, of which there are as many as the logarithm of the longest title
    sizes = [{(r["own"], r["band"]): r for r in rows.groupBy("own", "band").agg(F.count("*").alias("titles"), F.sum("n").alias("chars")).collect()} for rows in banded]
    parts = [{k: max(1, -(-r["titles"] // PART_TITLES), -(-r["chars"] // PART_CHARS)) for k, r in s.items()} for s in sizes]
    titles = lambda side, own, b: sizes[side][own, b]["titles"] // parts[side][own, b]
    dealt: list[list[tuple]] = [[] for _ in banded]
    tiles = pairs = 0
    for (own, b), n in parts[0].items():
        for i in range(n):
            if right is None:
                others = [(b, j) for j in range(i, n)] + [(b + 1, j) for j in range(parts[0].get((own, b + 1), 0))]
            else:
                others = [(c, j) for c in (b - 1, b, b + 1) for j in range(parts[1].get((own, c), 0))]
            for c, j in others:
                if right is None and (b, i) == (c, j):
                    dealt[0].append((own, b, i, n, tiles, "both"))
                else:
                    dealt[0].append((own, b, i, n, tiles, "left"))
                    dealt[-1].append((own, c, j, parts[-1][own, c], tiles, "right"))
                tiles += 1
                pairs += titles(0, own, b) * titles(-1, own, c)
    if not tiles:
        return left.sparkSession.createDataFrame([], "x long, y long, score double")
    whole = None
    for rows, where in zip(banded, dealt, strict=True):
        where = F.broadcast(left.sparkSession.createDataFrame(where, "own long, band int, part int, parts int, tile int, side string"))
        met = rows.join(where, ["own", "band"]).where(F.pmod(F.xxhash64("k"), F.col("parts")) == F.col("part")).select("tile", "side", "k", "every")
        whole = met if whole is None else whole.unionByName(met)

    def compare(table: pa.Table) -> pa.Table:
        numbers: dict[str, int] = {}
        side = np.asarray(table["side"].to_pylist())
        made = lambda rows: Part(table["k"].to_numpy()[rows], table["every"].take(pa.array(np.flatnonzero(rows))).to_pylist(), numbers)
        x = made(side != "right")
        y = x if (side == "both").any() else made(side == "right")
        found = alike_in_tile(x, y, len(numbers), threshold, similarity)
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip("x y score".split(), found, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return whole.repartition(min(tiles, TASKS, 1 + pairs // PAIRS), "tile").groupBy("tile").applyInArrow(compare, "x long, y long, score double")
