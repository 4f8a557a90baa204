"""Exact Jaccard join of 5-word shingle sets, and the components of its links.

Sets: distinct shingles as 64-bit hashes, one node per distinct set. Three rounds:

1. Stars. Each set has a few sketch keys (bands of bin minima). Sets with an equal key are compared with one pivot of
   theirs, the one that meets most others, which is linear and joins most copies.
2. Nearest. In large tiles (see 3) each set is compared exactly with that of the highest bound alone, which is linear
   too and joins most chains of copies of copies.
3. Tiles. Any two linked sets share one of their rarest shingles (a prefix of n - ceil(0.75 n) + 1 of them, shingles
   that are frequent somewhere last), so the prefixes' postings hold all candidates. A tile is the sets of one shingle;
   shingles of the same sets make one tile, and tiles of a single component are done with. In the others, sets of different components and comparable size band are
   compared by bitmap signatures whose width follows the band: bit counts bound the overlap from above. A tile of more
   than TILE sets is cut into blocks and its pairs of blocks are dealt to tasks; the blocks of its largest component
   meet only those of the others.

What passes in any round is intersected exactly, as sorted arrays. Pairs inside a component need no look: their link
changes nothing. So no link between different sets is lost, and no group of copies is ever expanded into pairs.

Defined cases: a null text, or one without words, has an empty set, links with nothing and is its own component; a
text of fewer than five words has its word sequence as the one shingle; rows with a null id get a null component, and
links through their sets count; rows with the same id are nodes of their own sets and are each returned; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import drop_ids, flagged, released, stored
from quire.llm.wordgrams import WordTable

WORDS = 5
_P = np.uint64(0x9E3779B97F4A7C15)
#: Shingles seen this often among so many of a task's shingles are put last in the order of prefixes.
FREQUENT, BLOCK = 6, 1_000_000
#: Bands of a sketch, and bin minima in each.
BANDS, ROWS = 10, 3
_EDGES = (np.arange(BANDS * ROWS, dtype=np.float64) * (2.0**64 / (BANDS * ROWS))).astype(np.uint64)
#: Sets of a tile that are compared in one task; from LARGE sets on, a tile takes part in the nearest round.
TILE, LARGE = 2000, 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes() -> WordTable:
    def compute(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    return WordTable(compute)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles of a sequence of word hashes, ascending."""
    n = min(WORDS, len(hashes))
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h * _P + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(h)


def sets_of(texts: list[bytes | None], table: WordTable) -> list[np.ndarray]:
    """Shingle sets of UTF-8 texts; bytes.lower() and bytes.split() know ASCII only, as the definition asks."""
    table.start()
    index = [table.index((t or b"").lower().split()) for t in texts]
    flat = table.table()[np.concatenate([np.zeros(0, np.int64), *index])]
    # all windows of the batch at once; those that reach over the end of a text are left out
    windows = np.full(max(0, len(flat) - WORDS + 1), WORDS, np.uint64)
    for k in range(WORDS):
        windows = _mixed(windows * _P + flat[k : k + len(windows)])
    sets, at = [], 0
    for i in index:
        n = len(i)
        sets.append(np.unique(windows[at : at + n - WORDS + 1]) if n >= WORDS else shingle_set(flat[at : at + n]))
        at += n
    return sets


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> list[int]:
    """Keys of the bands in which a set, ascending, has any value: alike sets share some key with high probability."""
    at = np.searchsorted(s, _EDGES)
    filled = np.append(at[1:], len(s)) > at
    least = np.where(filled, s[np.minimum(at, len(s) - 1)], np.uint64(0)).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _mixed(h * _P + least[:, k])
    return h[filled.reshape(BANDS, ROWS).any(1)].view(np.int64).tolist()


def width_of(n: int) -> int:
    """Bits of a set's signature: a power of two by its size band, four to eight times the set's size up to 512
    shingles, where most pairs are, and at least twice beyond, where most bytes are. It never falls as sets grow."""
    return 1 << min(17, max(8, (min(4 * n, max(2 * n, 2048)) - 1).bit_length()))


def signature(s: np.ndarray) -> bytes:
    bits = np.zeros(width_of(len(s)), bool)
    bits[s & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """At least the size of the intersection: a bit of one that the other lacks is a shingle that the other lacks."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    n_x, n_y = (n_a, n_b) if len(a) <= len(b) else (n_b, n_a)
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), 0)
    only = lambda p, q: int(np.bitwise_count(p & ~q).sum())
    return min(n_x - only(x, y), n_y - only(y, x))


def linked(overlap: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()


def describe_sets(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, key, signature, bands of each document. kind 1: key is a shingle seen n times in a block."""

    names = ["kind", "doc_id", "n", "key", "signature", "bands"]

    def task(batches):
        table, seen, held, size = word_hashes(), set(), [], 0

        def frequent():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= FREQUENT
            k = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(n[often].astype(np.int32)), pa.array(tokens[often].view(np.int64)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64()))],
                names=names,
            )

        for ids, texts in _parts(batches):
            sets = sets_of(texts, table)
            keys = [set_key(s) for s in sets]
            for s, key in zip(sets, keys, strict=True):
                if len(s) and key not in seen:
                    held.append(s)
                    size += len(s)
                    seen.add(key) if len(seen) < 2_000_000 else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(sets), pa.int32()), ids, pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=names,
            )
            if size >= BLOCK:
                yield frequent()
                held, size = [], 0
        if held:
            yield frequent()

    return _texts(docs).mapInArrow(task, "kind int, doc_id long, n int, key long, signature binary, bands array<long>")


def prefix_postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """slot, key, flags for the prefix of each set, once per set and task. frequent: shingles ascending, and their counts.

    slot: 48 bits of the shingle, which is enough to meet by, and for frequent ones ten of the key, to spread them.
    flags: 1 in the shorter prefix that is enough for the smaller set of a linked pair (their overlap is at least
    2t / (1 + t) of its size), plus 2 for a frequent shingle. Two numbers and a byte, as this is what moves most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def task(batches):
        tokens, counts = shared.value
        maybe = np.zeros(1 << 16, bool)
        maybe[tokens & np.uint64(0xFFFF)] = True
        table, seen = word_hashes(), set()
        for _, texts in _parts(batches):
            slots, flags, keys, lens = [], [], [], []
            for s in sets_of(texts, table):
                n = len(s)
                key = set_key(s)
                if not n or key in seen:
                    continue
                seen.add(key) if len(seen) < 2_000_000 else None
                p = n - -(-percent * n // 100) + 1
                short = n - -(-2 * percent * n // (100 + percent)) + 1
                rank = np.zeros(n, np.int64)
                likely = np.flatnonzero(maybe[s & np.uint64(0xFFFF)]) if len(tokens) else ()
                if len(likely):
                    at = np.minimum(np.searchsorted(tokens, s[likely]), len(tokens) - 1)
                    hit = tokens[at] == s[likely]
                    rank[likely[hit]] = counts[at[hit]]
                    order = np.lexsort((s, rank))[:p]
                    s, rank = s[order], rank[order]
                hot = rank[:p] > 0
                slots.append((s[:p] >> np.uint64(16) << np.uint64(10)).view(np.int64) | np.where(hot, key % 1009, 0))
                flags.append((np.arange(p) < short) + 2 * hot)
                keys.append(key)
                lens.append(p)
            if slots:
                columns = [pa.array(np.concatenate(slots)), pa.array(np.repeat(np.array(keys, np.int64), lens)), pa.array(np.concatenate(flags).astype(np.int8))]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "key", "flags"])

    return _texts(docs).mapInArrow(task, "slot long, key long, flags byte")


def tiles_of(postings: DataFrame) -> DataFrame:
    """tile, key, first: the sets of each shingle that several sets hold. Shingles of the same sets give one tile.

    A set of sets is known by its size, a sum and a xor of its keys. Hot shingles are shared anyway; they are spread
    over tasks, and summed up apart: there are at most as many as frequent shingles.
    """
    held = Window.partitionBy("slot")
    # a task names a set once for each of its shingles, so how often is the same for all of them
    parts = {"low": F.min("key"), "high": F.max("key"), "p0": F.count("*"), "p1": F.sum(F.pmod("key", F.lit(2**31 - 1))), "p2": F.bit_xor("key")}
    hot = F.col("flags") >= 2
    rows = postings.withColumns({k: p.over(held) for k, p in parts.items()}).where(hot | F.expr("low < high"))
    tile = F.xxhash64("p0", "p1", "p2")
    first = (F.col("flags") % 2 == 1).alias("first")
    rows = stored(rows.select(F.when(~hot, tile).alias("tile"), F.when(hot, F.shiftright("slot", 10)).alias("token"), "key", first), "join-shared")
    hot = rows.where("tile IS NULL").drop("tile")
    sums = hot.groupBy("token").agg(*(p.alias(k) for k, p in parts.items())).where("low < high").select("token", tile.alias("tile"))
    cold = rows.where("tile IS NOT NULL").drop("token")
    both = cold.unionByName(hot.join(F.broadcast(sums), "token").drop("token"))
    tiles = stored(both.groupBy("tile", "key").agg(F.max("first").alias("first")), "join-tiles")
    released(rows)
    return tiles


def arrays_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, shingles (binary, ascending uint64) for the wanted keys: the text of one document of each is read.

    Texts move only where the bitmap of wanted ids leaves a doubt.
    """
    chosen = stored(nodes.join(wanted, "key", "left_semi").select(F.col("key").alias("_key"), F.col("doc_id").alias("_wanted")), "join-wanted")
    texts = _texts(docs)
    by_id = chosen.where("_wanted IS NOT NULL")
    named = flagged(texts, F.col("doc_id"), by_id.select("_wanted")).where("quire__maybe").join(by_id, F.col("doc_id") == F.col("_wanted")).select("_key", "text")
    # sets that only rows without an id hold: their key is known when the text is read
    nameless = texts.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("_key"), "text")

    def task(batches):
        table = word_hashes()
        for keys, texts in _parts(batches):
            sets = sets_of(texts, table)
            own = [(set_key(s), s) for s in sets]  # an id may have several texts
            own = [(k, s.tobytes()) for (k, s), wanted in zip(own, keys.to_pylist(), strict=True) if wanted is None or k == wanted]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], names=["key", "shingles"])

    schema = "key long, shingles binary"
    found = nameless.mapInArrow(task, schema).join(chosen.where("_wanted IS NULL").select(F.col("_key").alias("key")), "key", "left_semi")
    return named.mapInArrow(task, schema).unionByName(found).dropDuplicates(["key"])


def bounded_pairs(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that bit counts leave: with n_a, n_b."""
    left = signatures.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    right = signatures.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))

    def task(batches):
        for batch in batches:
            a, b, n_a, s_a, n_b, s_b = (c.to_pylist() for c in batch.columns)
            keep = [linked(overlap_bound(x, n, y, m), n, m, percent) for x, n, y, m in zip(s_a, n_a, s_b, n_b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(task, "a long, b long")


def exact_links(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), the linked ones, by intersection of sorted arrays."""

    def task(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b, strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = arrays.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = arrays.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(task, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """key, root for all ends of links (a, b): alternating large and small stars until nothing moves."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "star")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", root).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", low)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small, "star")
        # a sum of hashes tells whether the set of edges has changed
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.countDistinct("u")).first()
        if now == state and now[0] == now[2]:
            break
        state = now
    roots = edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(roots)


def tile_pairs(n: np.ndarray, first: np.ndarray, root: np.ndarray, block: np.ndarray, signatures: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions i, j of a tile's rows, ascending by size n, whose sets have different roots and may be linked, and the
    bound of their similarity.

    first: whether the tile's shingle is in the row's shorter prefix, which the smaller set of a pair needs. block: if
    there are two, only rows of different blocks are compared.
    """
    widths = np.array([len(x) for x in signatures])
    two = block.min() != block.max()
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        bits = np.frombuffer(b"".join(signatures[i] for i in rows), np.uint64).reshape(len(rows), -1)
        more = np.flatnonzero(widths == 2 * w)
        folded = np.frombuffer(b"".join(signatures[i] for i in more), np.uint64).reshape(len(more), 2, bits.shape[1])
        others, other_bits = np.concatenate([rows, more]), np.concatenate([bits, np.bitwise_or.reduce(folded, 1)])
        other_pop = np.bitwise_count(other_bits).sum(1, dtype=np.int64)
        pop = other_pop[: len(rows)]
        step = max(1, 4_000_000 // max(1, other_bits.size))
        for at in range(0, len(rows), step):
            i, part = rows[at : at + step, None], bits[at : at + step]
            common = np.bitwise_count(part[:, None, :] & other_bits[None]).sum(2, dtype=np.int64)
            bound = np.minimum(n[i] - pop[at : at + step, None] + common, n[others] - other_pop + common)
            fits = (i < others) & (root[i] != root[others]) & (first[i] | (first[others] & (n[i] == n[others])))
            fits &= 100 * bound >= percent * (n[i] + n[others] - bound)
            if two:
                fits &= block[i] != block[others]
            a, b = np.nonzero(fits)
            yield i[a, 0], others[b], bound[a, b] / (n[i[a, 0]] + n[others[b]] - bound[a, b])


def dealt(rows: DataFrame, size: int = TILE, least_rows: int = 1) -> DataFrame:
    """Adds block, and the pairs (lo, hi) of blocks in which each row of (tile, key, first, n, root) is compared.

    A tile of up to `size` rows is one block. In a larger one, the rows of its most frequent root have blocks of their
    own, which meet the other rows' blocks and not one another. Tiles of fewer than least_rows rows are left out.
    """
    tiles = rows.groupBy("tile").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(F.col("first"), F.col("n"))).alias("least"))
    # the smaller set of a pair must have the shingle in its shorter prefix
    rows = rows.join(tiles.where(f"low < high AND rows >= {least_rows}"), "tile").where("n >= least").drop("low", "high", "least")
    by_root = rows.where(F.col("rows") > size).groupBy("tile", "root").agg(F.count("*").alias("n_root"))
    major = by_root.groupBy("tile").agg(F.max(F.struct("n_root", "root")).alias("m"), F.sum("n_root").alias("all"))
    major = major.select("tile", F.col("m.root").alias("major"), F.col("m.n_root").alias("n_major"), (F.col("all") - F.col("m.n_root")).alias("n_minor"))
    rows = rows.join(major, "tile", "left")
    many = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / size).cast("int")
    minors, majors = many("n_minor"), many("n_major")
    spread = F.xxhash64("key")
    is_major = F.col("root") == F.col("major")
    block = F.when(F.col("major").isNull(), 0).when(is_major, minors + F.pmod(spread, majors)).otherwise(F.pmod(spread, minors)).cast("int")
    pair = lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    last = F.when(is_major, minors).otherwise(minors + majors) - 1
    meets = F.when(F.col("major").isNull(), F.array(pair(F.lit(0), F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), last), lambda j: pair(F.col("block"), j)))
    return rows.withColumn("block", block).withColumn("meets", F.explode(meets)).select(*(c for c in rows.columns if c not in ("rows", "major", "n_major", "n_minor")), "block", "meets.lo", "meets.hi")


def cross_pairs(tiles: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Of rows (tile, lo, hi, block, n, first, key, root, signature), the pairs (a, b) of different roots in one pair of
    blocks that bit counts leave. nearest: of each row's pairs that with the highest bound alone."""

    def task(batches):
        found: set[tuple[int, int]] = set()
        tile, held = None, []

        def compare():
            if len(held) > 1:
                n, first, key, root, block, signatures = zip(*held, strict=True)
                n, first, key, root, block = (np.array(c) for c in (n, first, key, root, block))
                parts = tile_pairs(n.astype(np.int64), first, root, block, signatures, percent)
                for i, j in [best_of(list(parts))] if nearest else ((i, j) for i, j, _ in parts):
                    found.update(zip(np.minimum(key[i], key[j]).tolist(), np.maximum(key[i], key[j]).tolist(), strict=True))

        for batch in batches:
            for t, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, lo, hi) != tile:
                    compare()
                    tile, held = (t, lo, hi), []
                    if len(found) > 500_000:
                        yield _pairs(found)
                        found = set()
                held.append(row)
        compare()
        yield _pairs(found)

    def best_of(parts):
        i, j, bound = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(-np.concatenate([bound, bound]), kind="stable")
        _, best = np.unique(np.concatenate([i, j])[order], return_index=True)
        best = np.unique(order[best] % max(1, len(i)))
        return i[best], j[best]

    def _pairs(found):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    rows = tiles.select("tile", "lo", "hi", "n", "first", "key", "root", "block", "signature")
    rows = rows.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi", "n", "key")
    return rows.mapInArrow(task, "a long, b long").distinct()


def star_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b): each set with a pivot of each of its bands, the set that meets most others in all its bands."""
    bands = nodes.select(F.explode("bands").alias("band"), "key")
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    held = stored(bands.join(sizes, "band"), "join-bands")
    meets = held.groupBy("key").agg(F.sum("size").alias("meets"))
    # a set that others were copied from shares more of its bands than they do
    pivots = held.join(meets, "key").groupBy("band").agg(F.max(F.struct("meets", "key"))["key"].alias("pivot"))
    pairs = held.join(pivots, "band").where("key <> pivot")
    return pairs.select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b")).distinct()


def exactly(some: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The linked ones of stored pairs (a, b)."""
    ends = some.select(F.col("a").alias("key")).unionByName(some.select(F.col("b").alias("key"))).distinct()
    return stored(exact_links(some, arrays_of(docs, ends, nodes), percent), "join-links")


def near_duplicates(docs: DataFrame, percent: int = 75, most_frequent: int = 100_000, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    most_frequent: how many frequent shingles are put last in the order; it changes the work, never the links.
    tile: how many sets of a shingle are compared in one task.
    """
    every = stored(describe_sets(docs), "join-sets")
    top = every.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(most_frequent).collect()
    sets = every.where("kind = 0").select("doc_id", "n", "key")
    tokens = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    counts = np.array([r["n"] for r in top], np.int64)
    order = np.argsort(tokens)
    one = every.where("kind = 0 AND n > 0").groupBy("key")
    nodes = stored(one.agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "signature", "bands"))), "join-nodes")
    some = stored(bounded_pairs(star_pairs(nodes), nodes, percent), "join-pairs")
    links = exactly(some, docs, nodes, percent)
    roots = stored(components(links), "join-roots")

    tiles = tiles_of(prefix_postings(docs, (tokens[order], counts[order]), percent))
    rooted = lambda r: nodes.select("key", "n").join(r, "key", "left").withColumn("root", F.coalesce("root", "key"))
    for large in (True, False):
        labelled = stored(tiles.join(rooted(roots), "key"), "join-labelled")
        compared = dealt(labelled, tile, LARGE if large else 1).join(nodes.select("key", "signature"), "key")
        more = stored(cross_pairs(compared, percent, nearest=large), "join-pairs")
        links = links.unionByName(exactly(more, docs, nodes, percent))
        roots = stored(components(links), "join-roots")
        released(labelled, more)

    classes = nodes.select("key", F.col("doc_id").alias("first")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min("first").alias("component"))
    named = classes.join(least, "root").select(F.col("key").alias("_key"), "component")
    return sets.join(named, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the rows whose component has a document of a smaller id; all columns stay, rows with null ids too.

    Several rows of one id are kept or dropped together, by the smallest component among their texts. Null and empty
    texts stay; an empty table stays empty.
    """
    found = near_duplicates(docs, percent).where("component_id < doc_id").select("doc_id").distinct()
    return drop_ids(docs, stored(found, "join-copies"))
