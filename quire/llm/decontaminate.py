"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words. A leak of an item is a window as long as the item whose word edit distance to it is at
most `edits` of the item's length. Windows start at every word of every document.

1. Pigeonhole: an item of more than LONG words is cut into blocks of BLOCK words or a few more. If an item leaks, one
   of its blocks does with no more than its share of the edits. So windows, edits and repetitions stay bounded however
   long an item is. A shorter item is one block.
2. q-gram lemma: k edits spoil at most k words and 2k word pairs of a block, so a window without enough words and pairs
   known from some item can't hold one. This bound is exact and leaves few windows.
3. CGK: a random walk reads the window's words; at step j it emits its word and moves on by a random bit of (j, word).
   Edit distance becomes Hamming distance between the emitted strings.
4. Bit sampling: `bits` random steps of an embedding make a key; `repetitions` embeddings reach the target recall.
5. Windows and blocks with an equal key are compared by exact word edit distance, then the window of the whole item
   that the block points at.

The items are the stated queries: they go to the executors in parts of at most `block_chars` characters.

Defined cases: null or empty texts and items, and those of signs alone, have no words and leak nothing; items of a few
words, whose share of edits is none, are found where they stand word by word; repeated rows give one row for each
(doc_id, item_id); rows with a null id can't be named and are left out; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_ids, stored
from quire.llm.wordgrams import WordTable, normal

#: Chance that a random step of two embeddings agrees in spite of one edit; measured on random sequences in the tests.
AGREE = 0.89
#: Items of more words are cut into blocks of so many words, or a few more.
LONG, BLOCK = 48, 24
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def repetitions_for(recall: float, edits: int, bits: int) -> int:
    """Embeddings that make a leak of so many edits meet its item in some key with the target probability."""
    p = AGREE ** (edits * bits)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance, or most + 1 if it is larger. One bit of two long integers for each word of a (Myers 1999)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    y = b.tolist()
    if sum(w not in where for w in y) > most:  # each such word costs an edit
        return most + 1
    distance, every, last = len(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down = every, 0  # rows where the table grows or shrinks by one from the row above
    for w in y:
        same = where.get(w, 0)
        x = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | ~(h | up) & every, up & h
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | ~(x | more) & every, more & x
    return min(distance, most + 1)


def cgk_keys(words: np.ndarray, begins: np.ndarray, lengths: np.ndarray, samples: np.ndarray, seed: int) -> np.ndarray:
    """One key per window: what the walk emits at the sampled steps (ascending). Past its end a window emits 0."""
    at = np.zeros(len(begins), np.int64)
    key = np.full(len(begins), seed + 1, np.uint64)
    wanted = set(samples.tolist())
    for j in range(int(samples[-1]) + 1):
        inside = at < lengths
        w = np.where(inside, words[np.minimum(begins + at, len(words) - 1)] + np.uint64(1), np.uint64(0))
        if j in wanted:
            key = _mixed(key * _P + w)
        step = _mixed(w * _P + np.uint64(seed * 1_000_003 + j)) & np.uint64(1)
        at = at + step.astype(np.int64)
    return key


@dataclass(frozen=True)
class Block:
    item: int
    offset: int
    words: np.ndarray
    edits: int


def blocks_of(item: int, words: np.ndarray, edits: float) -> list[Block]:
    most = int(edits * len(words))
    parts = len(words) // BLOCK if len(words) > LONG else 1
    cuts = np.array_split(np.arange(len(words)), parts)
    return [Block(item, int(c[0]), words[c], most // parts) for c in cuts]


@dataclass
class Items:
    """Benchmark items as sequences of word numbers, and the keys of their blocks by length class."""

    ids: list[int]
    words: list[np.ndarray]
    number: dict[str, int]
    edits: float
    bits: int
    recall: float
    pairs: np.ndarray = field(init=False)
    blocks: list[Block] = field(init=False)
    classes: dict[int, dict] = field(init=False)

    def __post_init__(self):
        self.pairs = np.zeros(1 << 20, bool)
        for w in self.words:
            self.pairs[self.pair(w[:-1], w[1:])] = True
        self.blocks = [b for k, w in enumerate(self.words) for b in blocks_of(k, w, self.edits)]
        by_class = defaultdict(list)
        for k, b in enumerate(self.blocks):
            by_class[int(math.log(len(b.words)) / math.log(4 / 3))].append(k)
        self.classes = {}
        for c, members in by_class.items():
            lengths = np.array([len(self.blocks[k].words) for k in members], np.int64)
            shortest, longest, most = int(lengths.min()), int(lengths.max()), max(self.blocks[k].edits for k in members)
            rng = np.random.default_rng(1000 + c)
            tables = []
            flat, begins = np.concatenate([self.blocks[k].words for k in members]), np.cumsum(lengths) - lengths
            # without edits more steps cost no recall
            bits = min(2 * shortest, self.bits if most else 8)
            for r in range(repetitions_for(self.recall, most, bits)):
                # steps at which an item of any length of the class is still being read
                samples = np.sort(rng.choice(2 * shortest, bits, replace=False))
                keys = defaultdict(list)
                for k, key in zip(members, cgk_keys(flat, begins, lengths, samples, 64 * c + r).tolist(), strict=True):
                    keys[key].append(k)
                tables.append((samples, 64 * c + r, dict(keys), np.array(sorted(keys), np.uint64)))
            self.classes[c] = {"shortest": shortest, "longest": longest, "pairs": max(0, shortest - 1 - 2 * most), "words": max(0, shortest - most), "tables": tables}

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_mixed(a * _P + b) >> np.uint64(44)).astype(np.int64)


def make_items(rows: list[tuple[int, str | None]], edits: float, bits: int, recall: float) -> Items | None:
    ids, words, number = [], [], {}
    for item_id, text in rows:
        plain = [w for w in map(normal, (text or "").split()) if w]
        if plain:
            ids.append(item_id)
            words.append(np.array([number.setdefault(w, len(number) + 1) for w in plain], np.uint64))
    return Items(ids, words, number, edits, bits, recall) if ids else None


def numbered_words(items: Items) -> WordTable:
    """Raw word -> number among the items' words, 0 if no item has it, -1 if it has neither letter nor digit."""

    def compute(words: list[str]) -> np.ndarray:
        plain = [normal(w) for w in words]
        return np.fromiter((items.number.get(w, 0) if w else -1 for w in plain), np.int64, len(words))

    return WordTable(compute)


def leaks_in(texts: list[str | None], items: Items, table: WordTable) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, distance) of each item's best window in each text."""
    table.start()
    index = [table.index((t or "").split()) for t in texts]
    rows = table.table()
    numbers = [rows[i] for i in index]
    kept = [n[n >= 0] for n in numbers]
    sizes = np.array([len(k) for k in kept], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *kept]).astype(np.uint64)
    if not len(flat):
        return []
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    both = (flat[:-1] > 0) & (flat[1:] > 0) & (doc[:-1] == doc[1:])
    good = np.flatnonzero(both)
    good = good[items.pairs[items.pair(flat[good], flat[good + 1])]]
    hits = np.zeros(len(flat), np.int64)
    hits[good] = 1
    pairs, known = np.zeros((2, len(flat) + 1), np.int64)
    pairs[1:], known[1:] = np.cumsum(hits), np.cumsum(flat > 0)
    found_at: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    for c in items.classes.values():
        # known words and pairs among the first `shortest` words of the window that starts at each word
        at = np.arange(len(flat))
        enough = pairs[np.minimum(at + c["shortest"] - 1, len(flat))] - pairs[:-1] >= c["pairs"]
        starts = np.flatnonzero(enough)
        starts = starts[known[np.minimum(starts + c["shortest"], len(flat))] - known[starts] >= c["words"]]
        if not len(starts):
            continue
        room = ends[doc[starts]] - starts
        candidates: set[tuple[int, int]] = set()
        for samples, seed, keys, sorted_keys in c["tables"]:
            found = cgk_keys(flat, starts, np.minimum(room, c["longest"]), samples, seed)
            at = np.minimum(np.searchsorted(sorted_keys, found), len(sorted_keys) - 1)
            for s in np.flatnonzero(sorted_keys[at] == found):
                candidates.update((int(starts[s]), k) for k in keys[int(found[s])])
        for s, k in candidates:
            block, d = items.blocks[k], int(doc[s])
            # a block that lost or gained words stands in a window of its own length with twice the edits at most
            most = block.edits * (2 if len(block.words) < len(items.words[block.item]) else 1)
            if distance_at(block.words, flat, s, int(ends[d]), most) <= most:
                first = int(ends[d] - sizes[d])
                found_at[d, block.item].add((block.offset, max(first, s - block.offset)))
    out = []
    for (d, k), places in sorted(found_at.items()):
        item, first = items.words[k], int(ends[d] - sizes[d])
        most, best, tried = int(items.edits * len(item)), None, set()
        for _, s in sorted(places):
            if s in tried:
                continue
            tried.add(s)
            # what is no better than the best so far need not be told apart
            bound = most if best is None else best[0] - 1
            if bound < 0:
                break
            distance = distance_at(item, flat, s, int(ends[d]), bound)
            if distance <= bound:
                best = (distance, s - first)
        if best:
            out.append((d, k, best[1], len(item), best[0]))
    return out


def distance_at(item: np.ndarray, flat: np.ndarray, start: int, end: int, most: int) -> int:
    """Edit distance of item to the window as long as it, or to what is left of the text up to end."""
    window = flat[start : min(start + len(item), end)]
    return 0 if len(window) == len(item) and (window == item).all() else edit_distance(item, window, most)


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, distance long"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, edits: float = 0.15, bits: int = 2, recall: float = 0.95, block_chars: int = 16_000_000
) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance: of each item that leaks into a document, the best window found there.

    first_word counts the words that have a letter or digit.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    queries = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for k in range(blocks):
        block = [tuple(r) for r in queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        items = make_items(block, edits, bits, recall)
        if items is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def task(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            table = numbered_words(own)
            for pdf in batches:
                for at in range(0, len(pdf), 500):
                    part = pdf.iloc[at : at + 500]
                    ids = part["doc_id"].tolist()
                    leaks = leaks_in(part["text"].tolist(), own, table)
                    yield pd.DataFrame([(ids[d], own.ids[i], s, n, e) for d, i, s, n, e in leaks], columns=["doc_id", "item_id", "first_word", "n_words", "distance"])

        more = rows.mapInPandas(task, SCHEMA)
        found = more if blocks == 1 else found.unionByName(more)
    best = F.min(F.struct("distance", "first_word", "n_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.first_word", "best.n_words", "best.distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns. Rows with a null id, null or empty texts stay;
    rows of one id go together; without items or documents nothing goes."""
    leaks = stored(find_leaks(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return drop_ids(docs, leaks)
