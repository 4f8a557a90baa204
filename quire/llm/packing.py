"""Hierarchical multi-length packing of token streams.

Each task tokenizes its documents and cuts off their full windows of the longest tier. What is left of a document goes
to the smallest tier that holds it. Each tier is packed into windows of its own width, the longest tier first: its
longest remainder opens a window, and the gap is filled from the shorter tiers, largest fitting piece first, the last
one cut to size; what is cut off goes to the tier that holds it. Widths are powers of two and windows are full, so
nothing is padded; the rest at the end of a task becomes sequences of falling powers of two. Windows of all tiers are
dealt to step groups, each to the group with the fewest tokens and, of those, the least attention work (sum of squared
piece lengths), so that every step has as many tokens and about as much work.

Memory: one buffer of `buffer_tokens` ids besides the current batch, whatever the size of a task.

Defined cases: a null or empty text is the end id alone; repeated rows are packed one by one; a null id stays null;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
#: The end-of-text string is one id for the tokenizer of the JSON file.
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1)
    def exact():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            ids = exact().encode(text, add_special_tokens=False).ids
        else:
            try:
                ids = fast.encode_ordinary(text)
            except Exception:  # texts that its regular expression engine gives up on, such as a million equal letters
                ids = exact().encode(text, add_special_tokens=False).ids
        return np.array([*ids, 0], dtype="<u4")

    return encode


def default_tokenizer() -> dict:
    import public_tokenizers as P

    return {"json_path": P.path("byte_bpe_50k.json"), "ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


class _Packer:
    """Packs one task's documents; rows() hands out the finished pieces."""

    def __init__(self, tiers: tuple[int, ...], group: int, task: int):
        self.tiers, self.group = tuple(sorted(tiers)), group
        self.width = self.tiers[-1]
        self.next_sequence, self.next_group = task << 33, task << 33
        self.pools: list[list[tuple]] = [[] for _ in range(self.width + 1)]  # by length: (doc_id, start, ids, doc_tokens)
        self.filled = 0  # bit n: there are pieces of length n
        self.held = 0  # ids in the pools and in windows that wait for their step group
        self.done: dict[int, list[list[tuple]]] = {t: [] for t in self.tiers}
        self.out: list[tuple] = []

    def tier_of(self, length: int) -> int:
        return next(t for t in self.tiers if t >= length)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // self.width * self.width
        for s in range(0, full, self.width):
            self.done[self.width].append([(doc_id, s, ids[s : s + self.width], total)])
        if total > full:
            self.put((doc_id, full, ids[full:], total))
        self.held += total

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pools[n].append(piece)
        self.filled |= 1 << n

    def take(self, n: int) -> tuple:
        piece = self.pools[n].pop()
        if not self.pools[n]:
            self.filled &= ~(1 << n)
        return piece

    def longest(self, most: int) -> int:
        """Length of the longest piece of up to `most` ids, or 0."""
        found = self.filled & ((1 << (most + 1)) - 1)
        return found.bit_length() - 1 if found else 0

    def shortest(self, least: int) -> int:
        """Length of the shortest piece of `least` ids or more, or 0."""
        found = self.filled >> least
        return least + (found & -found).bit_length() - 1 if found else 0

    def window(self, tier: int) -> tuple[list[tuple], int]:
        """A window that the tier's longest piece opens, and the gap that is left when there are no pieces any more."""
        n = self.longest(tier)
        window, gap = [self.take(n)], tier - n
        while gap and self.filled:
            n = self.longest(gap)
            if n:
                window.append(self.take(n))
                gap -= n
                continue
            # nothing fits whole: the shortest longer piece, which is of a shorter tier if there is one, is cut
            doc_id, start, ids, total = self.take(self.shortest(gap + 1))
            window.append((doc_id, start, ids[:gap], total))
            self.put((doc_id, start + gap, ids[gap:], total))
            gap = 0
        return window, gap

    def flush(self, last: bool) -> None:
        for tier, shorter in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0], strict=True):
            while self.longest(tier) > shorter:
                window, gap = self.window(tier)
                if not gap:
                    self.done[tier].append(window)
                elif last:
                    self.tail(window)
                else:  # an open window waits for the next buffer
                    for piece in window:
                        self.put(piece)
                    break
        self.deal(last)
        pieces = sum(n * len(p) for n, p in enumerate(self.pools))
        self.held = pieces + sum(t * len(w) for t, w in self.done.items())

    def deal(self, last: bool) -> None:
        """Deals finished windows of all tiers to groups of group * width ids; those of an unfinished group wait."""
        size = self.group * self.width
        total = sum(t * len(w) for t, w in self.done.items())
        groups = -(-total // size) if last else total // size
        if not groups:
            return
        loads = [(0, 0, self.next_group + k) for k in range(groups)]
        for tier in reversed(self.tiers):
            work = lambda w: sum(len(p[2]) ** 2 for p in w)
            windows = sorted(self.done[tier], key=work, reverse=True)
            self.done[tier] = []
            for k, window in enumerate(windows):
                tokens, done, g = loads[0]
                if tokens + tier > size:  # all groups are full
                    self.done[tier] = windows[k:]
                    break
                heapq.heapreplace(loads, (tokens + tier, done + work(window), g))
                self.emit(window, g)
        self.next_group += groups

    def tail(self, window: list[tuple]) -> None:
        """The last open window, as sequences of falling powers of two."""
        while window:
            total = sum(len(p[2]) for p in window)
            room, part, rest = 1 << (total.bit_length() - 1), [], []
            for doc_id, start, ids, n in window:
                part += [(doc_id, start, ids[:room], n)] if room else []
                rest += [(doc_id, start + room, ids[room:], n)] if len(ids) > room else []
                room -= min(room, len(ids))
            self.emit(part, self.next_group)
            window = rest
        self.next_group += 1

    def emit(self, window: list[tuple], step_group: int) -> None:
        at, tier = 0, self.tier_of(sum(len(p[2]) for p in window))
        for doc_id, start, ids, total in window:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_sequence, at, tier, step_group))
            at += len(ids)
        self.next_sequence += 1

    def rows(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack_documents(
    docs: DataFrame,
    tokenizer: dict | None = None,
    width: int = 1024,
    tiers: tuple[int, ...] = (128, 256, 512, 1024),
    group: int = 8,
    buffer_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per piece: where it stands in its document, and in which sequence, tier and step group it stands.

    tokenizer: json_path, ranks_path and pattern of one byte-level vocabulary. The paths must exist on every worker.
    """
    files = tokenizer or default_tokenizer()
    if max(tiers) != width or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two, and the largest is the width of a window")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(**files)
        packer = _Packer(tiers, group, TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode(text.as_py() or ""))
                if packer.held >= buffer_tokens:
                    packer.flush(last=False)
                    yield packer.rows()
        packer.flush(last=True)
        yield packer.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCHEMA)
