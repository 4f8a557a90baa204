"""Hashed character n-grams of words, vectorised, and a bounded cache of what is computed per distinct word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def normal(word: str) -> str:
    """Lower case, without what surrounds the letters and digits."""
    word = word.lower()
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def gram_ids(words: list[str], buckets: int, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of up to `longest` characters, word ends marked (so affixes differ from inner grams):
    the index of its word, ascending for each n, and its bucket. Every word also has one bucket of its own."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, ids = [], []
    rolling = np.zeros(len(chars), np.uint32)
    for n in range(1, longest + 1):
        rolling = rolling[: len(chars) - n + 1] * _MIX[0] + (chars[n - 1 :] + np.uint32(n)) * _MIX[n % 4]
        inside = owner[: len(rolling)] == owner[n - 1 :]
        mixed = (rolling ^ (rolling >> np.uint32(15))) * _MIX[1]
        owners.append(owner[: len(rolling)][inside])
        ids.append((mixed >> np.uint32(7))[inside] % buckets)
    ends = np.cumsum(lengths)
    position = np.arange(len(chars)) - np.repeat(ends - lengths, lengths)
    weights = (chars * _MIX[2] ^ _MIX[3]) * (position.astype(np.uint32) * _MIX[1] + np.uint32(1))
    whole = np.add.reduceat(weights, ends - lengths).astype(np.uint32)
    owners.append(np.arange(len(words)))
    ids.append(((whole ^ (whole >> np.uint32(13))) * _MIX[0] >> np.uint32(7)) % buckets)
    return np.concatenate(owners), np.concatenate(ids).astype(np.int64)


def gram_sums(words: list[str], table: np.ndarray, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of its grams' rows of table, and how many grams it has."""
    owners, ids = gram_ids(words, len(table), longest)
    out = np.zeros((len(words), table.shape[1]), np.float64)
    for k in range(table.shape[1]):
        out[:, k] = np.bincount(owners, table[ids, k], len(words))
    return out.astype(np.float32), np.bincount(owners, minlength=len(words)).astype(np.float32)


class WordTable(dict):
    """word -> row number; rows are computed for all new words of a batch at once. Forgets all beyond `limit` words."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = 400_000):
        super().__init__()
        self.compute, self.limit, self.new, self.rows = compute, limit, [], None

    def __missing__(self, word: str) -> int:
        n = len(self)
        self[word] = n
        self.new.append(word)
        return n

    def index(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def start(self) -> None:
        """Call before a batch."""
        if len(self) > self.limit:
            self.clear()
            self.rows = None

    def table(self) -> np.ndarray:
        """Call after index() of a batch's texts."""
        if self.new or self.rows is None:
            more = self.compute(self.new)
            self.rows = more if self.rows is None else np.concatenate([self.rows, more])
            self.new = []
        return self.rows
