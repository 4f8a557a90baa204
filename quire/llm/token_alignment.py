"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, and which of their ids go together.

Each text, with one space in front, is encoded by a byte-level BPE (A) and a sentence-piece BPE (B). Their tokens give
two ascending lists of byte offsets at which tokens end. The shorter list drives a galloping search (doubling steps,
then a binary search between the last two) into the longer; the ranks of a common end in both lists cut the tokens into
groups, and the differences of successive ranks are the numbers of tokens that cover the same bytes.

A link is a pair of tokens that end together. One of two such tokens is a suffix of the other, so no more than the
summed byte lengths of both vocabularies (about half a million, twice that for single bytes, which B knows under two ids)
different pairs can ever be linked. The corpus counts of pairs are therefore bounded by the vocabularies, whatever the
corpus: tasks add their pairs up before they move, and the whole count table is broadcast.

Defined cases: a text that is null or empty, or that either tokenizer doesn't give back byte for byte (B reads U+2581 as
a space), has no tokens and thus zeros and an empty digest; strings of special tokens are plain text; repeated rows count
as often as they stand; a null id stays null; an empty table gives an empty result; other columns are ignored. A text is
encoded whole, in the memory of one task; batches are cut by characters, so that nothing else adds to it.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import stored

#: Characters that are encoded at once.
BATCH_CHARS = 1 << 20


def default_tokenizers() -> dict:
    import public_tokenizers as P

    return {"a_json": P.path("byte_bpe_50k.json"), "a_ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN, "b_model": P.path("piece_bpe_32k.model")}


def gallop(a: np.ndarray, b: np.ndarray, lane: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in a and in b of the values that two ascending lists share.

    The shorter list is cut into lanes. Each lane walks through the longer list with a cursor of its own, which doubles
    its step until it has passed the next value and then halves the last step; all lanes move at once.
    """
    if len(a) > len(b):
        return gallop(b, a, lane)[::-1]
    n = len(b)
    rank = np.empty(len(a), np.int64)
    cursor = np.searchsorted(b, a[::lane])
    for k in range(min(lane, len(a))):
        x = a[k::lane]
        low, step = cursor[: len(x)], np.ones(len(x), np.int64)
        while len(x):
            before = b[np.minimum(low + step, n) - 1] < x
            before &= low + step <= n
            if not before.any():
                break
            low = np.where(before, low + step, low)
            step <<= before
        high = np.minimum(low + step - 1, n)
        while (low < high).any():
            middle = (low + high) >> 1
            before = (b[np.minimum(middle, n - 1)] < x) & (low < high)
            low, high = np.where(before, middle + 1, low), np.where(before, high, middle)
        rank[k::lane] = cursor = low
    met = rank < n
    met[met] = b[rank[met]] == a[met]
    return np.flatnonzero(met), rank[met]


class Vocabulary:
    """Bytes and byte lengths of all ids of one tokenizer."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.lengths = pieces, np.array([len(x) for x in pieces], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def _tokenizers(a_json: str, a_ranks: str, pattern: str, b_model: str):
    """Both encoders of a list of texts, and both vocabularies."""
    import sentencepiece
    import tiktoken

    with open(a_ranks, "rb") as f:
        ranks = {base64.b64decode(x): int(k) for x, k in map(bytes.split, f)}
    fast = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    by_id = {k: x for x, k in ranks.items()}

    @lru_cache(maxsize=1)
    def exact():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(a_json)
        found.encode_special_tokens = True
        return found

    def one(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except Exception:  # texts that its regular expression engine gives up on, such as a million equal letters
            return exact().encode(text, add_special_tokens=False).ids

    b = sentencepiece.SentencePieceProcessor(model_file=b_model)
    names = b.id_to_piece(list(range(b.get_piece_size())))
    pieces = [bytes([int(x[3:5], 16)]) if b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
    a_vocabulary = Vocabulary([by_id.get(k, b"") for k in range(max(by_id) + 1)])
    return (lambda texts: [one(" " + t) for t in texts]), (lambda texts: b.encode(texts, num_threads=1)), a_vocabulary, Vocabulary(pieces)


class Aligned:
    """The tokens of some texts, one text after the other, by both tokenizers, and the ranks at which both end.

    As both cover the same bytes of every text, the end of a text is an end of both.
    """

    def __init__(self, encoded_a: list[list[int]], encoded_b: list[list[int]], texts: list[str], va: Vocabulary, vb: Vocabulary):
        whole = [b" " + t.encode() for t in texts]
        same = [bool(t) and va.joined(a) == w and vb.joined(b) == w for a, b, t, w in zip(encoded_a, encoded_b, texts, whole)]
        kept = [[x if ok else [] for x, ok in zip(encoded, same)] for encoded in (encoded_a, encoded_b)]
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64) for x in kept)
        self.a_starts, self.b_starts = (np.cumsum([0, *map(len, x)]) for x in kept)
        self.a_ends, self.b_ends = np.cumsum(va.lengths[self.a]), np.cumsum(vb.lengths[self.b])
        self.a_ranks, self.b_ranks = gallop(self.a_ends, self.b_ends)
        self.group_starts = np.searchsorted(self.a_ranks, self.a_starts)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of ids that end together, as a << 22 | b, text after text; how often each does; where texts begin."""
        text = np.repeat(np.arange(len(self.a_starts) - 1), np.diff(self.group_starts))
        found, times = np.unique(text << 44 | self.a[self.a_ranks] << 22 | self.b[self.b_ranks], return_counts=True)
        return found & ((1 << 44) - 1), times, np.searchsorted(found >> 44, np.arange(len(self.a_starts)))

    def digests(self) -> list[str]:
        """Per text sha256 of its groups: ids by commas, A before B by a bar, groups by semicolons."""
        # a token stands behind all tokens of earlier groups, one of B also behind those of A in its group
        in_a, in_b = np.arange(len(self.a)), np.arange(len(self.b))
        b_before = np.concatenate(([0], self.b_ranks + 1))
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        for values, place, ends, last in (
            (self.a, in_a + b_before[np.searchsorted(self.a_ranks, in_a)], self.a_ranks, b"|"),
            (self.b, in_b + self.a_ranks[np.searchsorted(self.b_ranks, in_b)] + 1, self.b_ranks, b";"),
        ):
            ids[place] = values
            mark[place[ends]] = ord(last)
        shown = _decimals()[ids]
        shown[:, -1] = mark
        at = np.concatenate(([0], np.cumsum(_widths()[ids] + 1)))[self.a_starts + self.b_starts].tolist()
        shown = shown[shown != 0].tobytes()
        return [hashlib.sha256(shown[i : j - 1]).hexdigest() if i < j else "" for i, j in zip(at, at[1:])]


@lru_cache(maxsize=1)
def _decimals() -> np.ndarray:
    """Digits of all numbers below 100,000, padded in front by zero bytes, with room for a mark behind."""
    n = np.arange(100_000)[:, None]
    powers = 10 ** np.arange(4, -1, -1)
    digits = np.where((n >= powers) | (powers == 1), n // powers % 10 + ord("0"), 0)
    return np.concatenate([digits, np.zeros_like(n)], axis=1).astype(np.uint8)


@lru_cache(maxsize=1)
def _widths() -> np.ndarray:
    return (_decimals() != 0).sum(axis=1)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, so many at once as hold BATCH_CHARS characters or one row."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py() or ""
        if texts and size + len(text) > BATCH_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def _aligned(batches: Iterator[pa.RecordBatch], files: dict) -> Iterator[tuple[list, Aligned]]:
    encode_a, encode_b, va, vb = _tokenizers(**files)
    for batch in batches:
        for ids, texts in _texts(batch):
            yield ids, Aligned(encode_a(texts), encode_b(texts), texts, va, vb)


def token_groups(docs: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """(doc_id, start, stop, a_ids, b_ids): one row per group of tokens that cover the same bytes of space and text."""
    files, kind = tokenizers or default_tokenizers(), docs.schema["doc_id"].dataType

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _aligned(batches, files):
            sizes = np.diff(x.group_starts)
            stops = np.concatenate(([0], x.a_ends[x.a_ranks]))
            begins = np.repeat(stops[x.group_starts[:-1]], sizes)
            cut = lambda v, ranks: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ranks + 1)), pa.int32()), pa.array(v, pa.int32()))
            columns = [pa.array(ids, to_arrow_type(kind)).take(pa.array(np.repeat(np.arange(len(ids)), sizes))), stops[:-1] - begins, stops[1:] - begins, cut(x.a, x.a_ranks), cut(x.b, x.b_ranks)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["doc_id", "start", "stop", "a_ids", "b_ids"])

    return docs.select("doc_id", "text").mapInArrow(groups, f"doc_id {kind.simpleString()}, start long, stop long, a_ids array<int>, b_ids array<int>")


def link_documents(docs: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): per row its distinct links with their numbers."""
    files, kind = tokenizers or default_tokenizers(), docs.schema["doc_id"].dataType
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _aligned(batches, files):
            pairs, times, starts = x.links()
            # every common end is the end of one group and of one linked pair
            counts = [np.diff(v) for v in (x.a_starts, x.b_starts, x.group_starts, x.group_starts)]
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v, t)) for v, t in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), *(pa.array(c, pa.int64()) for c in counts), pa.array(x.digests(), pa.string()), *lists], names)

    schema = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return docs.select("doc_id", "text").mapInArrow(link, schema)


def count_links(linked: DataFrame) -> DataFrame:
    """(a, b, n, best): how often each pair of ids is linked in all rows, and whether no other A id is linked more often to that B id."""
    pairs = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    ids = pairs.select(F.shiftright("pair", 22).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 22) - 1)).alias("b"), "n")
    highest = ids.groupBy(F.col("b").alias("highest_b")).agg(F.max("n").alias("highest"))
    return ids.join(highest, F.col("b") == F.col("highest_b")).select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def align_tokenizers(docs: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs."""
    linked = stored(link_documents(docs, tokenizers), "token-links")
    # bounded by the vocabularies, see above
    found = count_links(linked).toPandas().sort_values(["a", "b"])
    table = docs.sparkSession.sparkContext.broadcast((found["a"].to_numpy(np.int64) << 22 | found["b"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["best"].to_numpy(bool)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            *kept, pairs, times = batch.columns
            flat, times = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.searchsorted(pair, flat)
            ends = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy())))
            summed = lambda v, ends=ends: np.diff(np.concatenate(([0], np.cumsum(v)))[ends])
            per_row = [summed(times * best[at]), summed(times * n[at])] if len(flat) else [np.zeros(len(batch), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*kept[:5], *(pa.array(x, pa.int64()) for x in per_row), kept[5]], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = linked.schema["doc_id"].dataType.simpleString()
    return linked.mapInArrow(count, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
