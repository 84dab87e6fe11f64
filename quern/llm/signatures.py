"""Problem 3: near-duplicates by set overlap, with signature trees.

The trees hang below an exact routing: the tokens of all sets are ordered from rare to frequent, and two
sets of Jaccard similarity t or more must share one of the first n - ceil(t n) + 1 of their tokens. A route is
a range of tokens; its records form one deep tree whose nodes hold the OR of their members' bitmaps and the
ranges of their sizes and tokens. Traversing the tree against itself from the root prunes node pairs by the
greatest overlap they can have. What is left is compared exactly. No pair of sufficient similarity is lost at
any step. Records with equal sets are one class, which is compared with the others once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut

#: Buckets of the frequency sketch that orders the tokens; any order gives the exact result, a good one is fast.
SKETCH_BITS, SKETCH_CHUNKS = 20, 16
#: Bits of a record's bitmap, and records of a token that share one tree; larger groups are split.
BITMAP_WORDS, TREE_RECORDS = 8, 1024
_LEAF, _FANOUT = 8, 8
#: Rows of a token that are looked through pair by pair before any bitmap is made.
SMALL_GROUP = 16
#: So many keys are broadcast at most (8 bytes each); more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Bits of the filter of keys that candidates name: so many for each candidate, and this power of two at most (16 MB).
FILTER_BITS_EACH, FILTER_BITS = 8, 27
#: Copies of a class that meet in one task while pairs are listed; larger classes are salted.
CLASS_PART = 1000
_WORD = re.compile(r"[^\W_]+")
#: Bytes of a token: two sets of a thousand tokens agree in one by chance once in 10**8 pairs.
TOKEN_BYTES = 6
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Collection:
    """One table of texts and what counts as a near-duplicate in it."""

    name: str
    words: int
    threshold: float
    least: int = 1


def packed(tokens: np.ndarray) -> bytes:
    """Tokens of TOKEN_BYTES bytes each."""
    return np.ascontiguousarray(tokens.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.view("<i8").reshape(-1).astype(np.int64)


class Shingler:
    """Sorted distinct 48-bit hashes of the runs of ``words`` consecutive words of a text."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter((memo[w] for w in words), np.uint64, len(words))

    def __call__(self, text: str | None, words: int, seed: int) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        if len(found) < words:
            return np.empty(0, np.int64)
        h = self._hashes(found)
        n = len(h) - words + 1
        with np.errstate(over="ignore"):
            out = np.full(n, np.uint64(seed + 1) * _MIX, np.uint64)
            for i in range(words):
                out = (out ^ h[i : i + n]) * _ODD
                out ^= out >> np.uint64(29)
        return np.unique((out >> np.uint64(64 - 8 * TOKEN_BYTES)).view(np.int64))


def token_sets(tables: list[tuple[Collection, DataFrame]]) -> DataFrame:
    """(key, tab, id, n, order, digest, tokens) of every row with a text, from (id, text, order) each.

    Sets below a collection's least size are left out: they can't be part of a pair.
    """
    specs = [c for c, _ in tables]
    rows = None
    for tab, (_, df) in enumerate(tables):
        part = df.select(F.lit(tab).alias("tab"), F.col("id").cast("string").alias("id"), F.col("text").alias("text"), F.col("order").cast("timestamp").alias("order"))
        rows = part if rows is None else rows.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            tabs = batch.column(0).to_pylist()
            sets = [shingle(t, specs[tab].words, tab) for t, tab in zip(batch.column(2).to_pylist(), tabs)]
            keep = [i for i, s in enumerate(sets) if len(s) >= max(1, specs[tabs[i]].least)]
            raw = [packed(sets[i]) for i in keep]
            digests = [xxhash.xxh3_128_digest(r) for r in raw]
            chosen = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen), batch.column(3).take(chosen), pa.array([len(sets[i]) for i in keep], pa.int32()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())],
                names=["tab", "id", "order", "n", "digest", "tokens"],
            )

    shaped = rows.where("text is not null").mapInArrow(run, "tab int, id string, order timestamp, n int, digest binary, tokens binary")
    return shaped.withColumn("key", F.monotonically_increasing_id())


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch, and where each row's begin."""
    raw = column.to_pylist()
    ends = np.cumsum([0] + [len(r) // TOKEN_BYTES for r in raw])
    return unpacked(b"".join(raw)), ends


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return tokens >> (8 * TOKEN_BYTES - SKETCH_BITS)


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """How many sets have a token of each bucket (2**SKETCH_BITS numbers, whatever the size of the data)."""
    part = (1 << SKETCH_BITS) // SKETCH_CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            tokens, _ = _tokens(batch.column(0))
            total += np.bincount(_bucket(tokens), minlength=1 << SKETCH_BITS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array([total[i * part : (i + 1) * part].tobytes() for i in range(SKETCH_CHUNKS)], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    out = np.zeros((SKETCH_CHUNKS, part), np.uint32)
    for r in sets.select("tokens").mapInArrow(count, kind).repartition(SKETCH_CHUNKS, "chunk").mapInArrow(add, kind).collect():
        out[r.chunk] = np.frombuffer(r.counts, np.uint32)
    return out.reshape(-1)


def routed(sets: DataFrame, sketch: np.ndarray, specs: list[Collection]) -> DataFrame:
    """(token, key, shape): the rare tokens of each set, of which similar sets share one.

    ``shape`` holds the table, the size of the set and the place of the token among its rare ones.
    """
    shared = sets.sparkSession.sparkContext.broadcast(sketch)
    thresholds = [c.threshold for c in specs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            tokens, ends = _tokens(batch.column(2))
            weight = frequency[_bucket(tokens)]
            chosen, owners, shapes = [], [], []
            for i, (key, tab) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                mine = slice(ends[i], ends[i + 1])
                n = ends[i + 1] - ends[i]
                first = n - int(np.ceil(thresholds[tab] * n - 1e-9)) + 1
                order = np.lexsort((tokens[mine], weight[mine]))[:first]
                chosen.append(tokens[mine][order])
                owners.append(np.full(len(order), key, np.int64))
                shapes.append((int(tab) << 60 | int(n) << 30) + np.arange(len(order)))
            if chosen:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(shapes))], names=["token", "key", "shape"])

    return sets.select("key", "tab", "tokens").mapInArrow(run, "token bigint, key bigint, shape bigint")


def partnered(token: np.ndarray, shape: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Which rows, sorted by token and shape, have a possible partner at their token.

    Two sets whose first common token has places i and j have at most min(n - i, m - j) tokens in common. In
    groups of up to SMALL_GROUP rows every pair is looked at; in larger ones a row stays if some row that is
    small enough for it could have a partner of its size.
    """
    t = thresholds[shape >> 60]
    n, place = (shape >> 30) & 0x3FFFFFFF, shape & 0x3FFFFFFF
    share = t / (1 + t)
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(token)]]))
    size = np.repeat(sizes, sizes)
    out = np.zeros(len(token), bool)
    a = np.flatnonzero((size > 1) & (size <= SMALL_GROUP))
    for step in range(1, SMALL_GROUP):
        a = a[(size[a] > step) & (a + step < len(token))]
        a = a[token[a] == token[np.minimum(a + step, len(token) - 1)]]
        if not len(a):
            break
        b = a + step
        ok = (n[a] >= t[a] * n[b] - 1e-9) & (np.minimum(n[a] - place[a], n[b] - place[b]) >= share[a] * (n[a] + n[b]) - 1e-9)
        out[a[ok]] = out[b[ok]] = True
    # the largest partner that a row's place allows
    most = (n - place + 1e-6) / share - n
    for s, length in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
        rows = slice(s, s + length)
        reach = np.searchsorted(n[rows], most[rows], "right")  # sizes ascend within a token
        best = np.concatenate([[-1.0], np.maximum.accumulate(most[rows])])[reach]
        out[rows] = (most[rows] >= t[rows] * n[rows] - 1e-9) & (best >= n[rows])
    return out


def meeting(postings: DataFrame, specs: list[Collection]) -> DataFrame:
    """(token, key, slot, n) of the tokens at which sets can meet a partner; slot counts parts of TREE_RECORDS members.

    Streams through sorted partitions; however many sets have a token, only a small group is held.
    """
    thresholds = np.array([c.threshold for c in specs])

    def batch_of(token: np.ndarray, key: np.ndarray, shape: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        n = ((shape >> 30) & 0x3FFFFFFF).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(key), pa.array((place // TREE_RECORDS).astype(np.int32)), pa.array(n)], names=["token", "key", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # the last group, while it is small
        large, given = 0, 0  # the last group, once it is large, and how many of its rows are out
        for batch in batches:
            rows = tuple(batch.column(i).to_numpy() for i in range(3))
            if given and len(rows[0]):
                more = int(np.searchsorted(rows[0] != large, True)) if rows[0][0] == large else 0
                if more:
                    yield batch_of(*(r[:more] for r in rows), given + np.arange(more))
                    given += more
                rows = tuple(r[more:] for r in rows)
            if held is not None:
                rows = tuple(np.concatenate([h, r]) for h, r in zip(held, rows))
                held = None
            token, key, shape = rows
            if not len(token):
                continue
            last = int(np.searchsorted(token == token[-1], True))
            if len(token) - last <= SMALL_GROUP:
                held = tuple(r[last:] for r in rows)
                token, key, shape = (r[:last] for r in rows)
                given = 0
            else:
                large, given = int(token[-1]), len(token) - last
            if len(token):
                keep = partnered(token, shape, thresholds)
                starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                place = np.arange(len(token)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(token)]])))
                if keep.any():
                    yield batch_of(token[keep], key[keep], shape[keep], place[keep])
        if held is not None:
            token, key, shape = held
            keep = partnered(token, shape, thresholds)
            if keep.any():
                yield batch_of(token[keep], key[keep], shape[keep], np.arange(len(token))[keep])

    return postings.repartition("token").sortWithinPartitions("token", "shape").mapInArrow(run, "token bigint, key bigint, slot int, n int")


def bitmaps(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BITMAP_WORDS words for each set: one bit for each token, several tokens may share a bit."""
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    bit = tokens % (64 * BITMAP_WORDS)
    flags = np.zeros((len(ends) - 1, 64 * BITMAP_WORDS), np.uint8)
    flags[rows, bit] = 1
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


class SignatureTree:
    """Nodes over the records of a route: OR of the bitmaps, ranges of the sizes and groups, greatest number of tokens without a bit of their own.

    ``group`` numbers the tokens at which records meet; a pair counts only within a group. ``thresholds`` may
    differ between groups; a node has the least one below it.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, thresholds: np.ndarray, group: np.ndarray | None = None):
        group = np.zeros(len(n), np.int64) if group is None else group
        self.order = np.lexsort((bits[:, 0], n, group))
        n, bits, group, t = n[self.order], bits[self.order], group[self.order], thresholds[self.order]
        spare = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, spare, group, group, t)]
        self.width: list[int] = []
        self.tested = np.zeros(2, np.int64)  # pairs of nodes and of records looked at
        while len(self.levels[-1][0]) > 1:
            step = _LEAF if len(self.levels) == 1 else _FANOUT
            at = np.arange(0, len(self.levels[-1][0]), step)
            how = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.minimum)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip(how, self.levels[-1])))
            self.width.append(step)

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes have, by their ranges and bitmaps, some pair below them that can reach its threshold."""
        bits, low, high, spare, first, last, least = self.levels[level]
        self.tested[int(level == 0)] += len(a)
        t = np.minimum(least[a], least[b])
        meet = (first[a] <= last[b]) & (first[b] <= last[a]) & (high[a] >= t * low[b] - 1e-9) & (high[b] >= t * low[a] - 1e-9)
        at = np.flatnonzero(meet)
        a, b, t = a[at], b[at], t[at]
        overlap = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(spare[a], spare[b])
        overlap = np.minimum(overlap, np.minimum(high[a], high[b]))
        meet[at] = overlap >= t / (1 + t) * (low[a] + low[b]) - 1e-9
        return meet

    def pairs(self, most: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes of pairs of records that the nodes don't rule out, by traversing the tree against itself."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))] if top else []
        while stack:
            level, a, b = stack.pop()
            ok = self._possible(level, a, b) | ((a == b) & (level > 0))
            a, b = a[ok], b[ok]
            if level == 0:
                if len(a):
                    yield self.order[a], self.order[b]
                continue
            step, below = self.width[level - 1], len(self.levels[level - 1][0])
            for at in range(0, len(a), max(1, most // step**2)):
                part = slice(at, at + max(1, most // step**2))
                i, j = np.divmod(np.arange(step * step), step)
                left = (a[part, None] * step + i).reshape(-1)
                right = (b[part, None] * step + j).reshape(-1)
                keep = (left < below) & (right < below) & ((left <= right) if level > 1 else (left < right))
                stack.append((level - 1, left[keep], right[keep]))


def tree_candidates(met: DataFrame, sets: DataFrame, specs: list[Collection]) -> DataFrame:
    """(a, b): distinct pairs of keys that the signature trees leave over, one deep tree for each range of tokens."""
    thresholds = [c.threshold for c in specs]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                tokens, ends = _tokens(part.column(3))
                marks = bitmaps(tokens, ends)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([m.tobytes() for m in marks], pa.binary())], names=["key", "tab", "n", "bits"])

    described = sets.select("key", "tab", "n", "tokens").mapInArrow(describe, "key bigint, tab int, n int, bits binary")
    # tokens of more than TREE_RECORDS members: any two parts whose sizes can fit get a group of their own
    parts = met.groupBy("token", "slot").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    hot = parts.join(parts.where("slot > 0").select("token").distinct(), "token", "left_semi")
    mine, theirs = (hot.select("token", F.col("slot").alias(f"slot{i}"), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")) for i in (1, 2))
    least = min(thresholds)
    fits = mine.join(theirs, "token").where((F.col("hi1") >= least * F.col("lo2")) & (F.col("hi2") >= least * F.col("lo1"))).select("token", F.col("slot1").alias("slot"), F.col("slot2").alias("other"))
    if (split := fits.count()) <= BROADCAST_KEYS:
        fits = F.broadcast(fits)
    alone = F.col("slot").alias("other")
    keyed = (met.join(fits, ["token", "slot"], "left").select("token", "key", "slot", F.coalesce("other", "slot").alias("other")) if split else met.select("token", "key", "slot", alone))
    keyed = keyed.select("token", "key", "slot", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"))
    groups = keyed.join(described, "key").select("token", "low", "high", "slot", "key", "tab", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        kept: pa.RecordBatch | None = None

        def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            plain = [batch.column(i).to_numpy() for i in range(7)]
            return (*plain, np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS))

        def emit(data: tuple[np.ndarray, ...]) -> pa.RecordBatch | None:
            token, low, high, slot, key, tab, n, bits = data
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            tree = SignatureTree(n.astype(np.int64), bits, np.array(thresholds)[tab], np.cumsum(new))
            left, right = [], []
            for a, b in tree.pairs():
                across = (low[a] == high[a]) | (slot[a] != slot[b])  # a group of two parts counts only across them
                left.append(key[a[across]])
                right.append(key[b[across]])
            if not left:
                return None
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"]) if len(pairs) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            data = arrays(batch)
            if held:
                data = tuple(np.concatenate([h, d]) for h, d in zip(held.pop(), data))
            token, low, high = data[:3]
            # the last group may go on in the next batch; it has at most 2 * TREE_RECORDS rows
            open_ = np.flatnonzero((token != token[-1]) | (low != low[-1]) | (high != high[-1]))
            end = int(open_[-1]) + 1 if len(open_) else 0
            held.append(tuple(d[end:] for d in data))
            if end and (kept := emit(tuple(d[:end] for d in data))) is not None:
                yield kept
        if held and (kept := emit(held.pop())) is not None:
            yield kept

    sorted_groups = groups.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return sorted_groups.mapInArrow(run, "a bigint, b bigint").distinct()


def leaving_out(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """``sets`` without ``keys``; without a shuffle of the sets while the keys are few enough to broadcast."""
    if keys.count() <= BROADCAST_KEYS:
        return sets.join(F.broadcast(keys), "key", "left_anti")
    return cut(sets.join(keys, "key", "left_anti"))


def named_only(sets: DataFrame, candidates: DataFrame, side: str) -> DataFrame:
    """(key, tab, tokens) of the sets that candidates may name in column ``side``, by a bitmap of fixed size; the join decides."""
    key, size = F.col(side), 1 << max(15, min(FILTER_BITS, (FILTER_BITS_EACH * candidates.count()).bit_length()))
    places = candidates.select(F.pmod(key + F.shiftright(key, 33) * 7919, F.lit(size)).alias("p"))
    chunks = places.groupBy(F.floor(F.col("p") / 32_768).alias("chunk")).agg(F.bitmap_construct_agg(F.col("p") % 32_768).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in chunks:
        bits[r.chunk * 4096 : (r.chunk + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            p = (key + (key >> 33) * 7919) % size
            yield batch.filter(pa.array((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))

    return sets.select("key", "tab", "tokens").mapInArrow(run, "key bigint, tab int, tokens binary")


def verified(candidates: DataFrame, sets: DataFrame, specs: list[Collection]) -> DataFrame:
    """(tab, a, b, similarity) of the candidates whose exact Jaccard similarity reaches the threshold."""
    thresholds = [c.threshold for c in specs]
    candidates = cut(candidates)
    one = candidates.join(named_only(sets, candidates, "a").select(F.col("key").alias("a"), "tab", F.col("tokens").alias("tokens_a")), "a")
    both = one.join(named_only(sets, candidates, "b").select(F.col("key").alias("b"), F.col("tokens").alias("tokens_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, similarity = [], []
            for i, (tab, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                a, b = unpacked(x), unpacked(y)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= thresholds[tab] * (len(a) + len(b) - common) - 1e-9:
                    keep.append(i)
                    similarity.append(common / (len(a) + len(b) - common))
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(similarity, pa.float64())], names=["tab", "a", "b", "similarity"])

    return both.select("tab", "a", "b", "tokens_a", "tokens_b").mapInArrow(run, "tab int, a bigint, b bigint, similarity double")


def similar_classes(tables: list[tuple[Collection, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(tab, id, head, copies) of every record, and (tab, a, b, similarity): the links between classes of equal sets.

    A class is named by the key ``head`` of one of its records, ``a`` and ``b`` are heads. Each table has id,
    text and order; the newest row of an id counts. Words are maximal runs of letters and digits in lower
    case. Null, empty and too short texts and null ids are left out.
    """
    specs = [c for c, _ in tables]
    sets = cut(token_sets(tables))
    # who is who: narrow rows only
    newest_first = Window.partitionBy("tab", "id").orderBy(F.col("order").desc_nulls_last(), F.col("key"))
    current = sets.where("id is not null").select("key", "tab", "id", "order", "digest").withColumn("r", F.row_number().over(newest_first)).where("r = 1").drop("r", "order")
    heads = current.groupBy("tab", "digest").agg(F.min("key").alias("head"), F.count("*").alias("copies"))
    several = heads.where("copies > 1").select("tab", "digest", "head", "copies")
    members = cut(current.join(several, ["tab", "digest"], "left").select("key", "tab", "id", F.coalesce("head", "key").alias("head"), F.coalesce("copies", F.lit(1)).alias("copies")))
    # copies other than the first, and rows that a newer one replaced, are taken out; both are few and narrow
    out = sets.select("key").join(members.where("key = head").select("key"), "key", "left_anti")
    single = leaving_out(sets, out).select("key", "tab", "n", "tokens")
    met = cut(meeting(routed(single, frequency_sketch(single), specs), specs))
    return members.drop("key"), verified(tree_candidates(met, single, specs), single, specs)


def similar_pairs(tables: list[tuple[Collection, DataFrame]]) -> DataFrame:
    """(table_name, id_a, id_b, similarity), the smaller id first: all pairs of different ids of a table at or above its threshold.

    As :func:`similar_classes`, with the classes expanded into all their pairs; large classes meet in parts of
    CLASS_PART records.
    """
    specs = [c for c, _ in tables]
    members, links = similar_classes(tables)
    parts = F.ceil(F.col("copies") / CLASS_PART).cast("int")
    each = F.explode(F.sequence(F.lit(0), parts - 1))
    salted = members.select("tab", "head", "id", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "copies")
    sizes = members.where(parts > 1).select("head", parts.alias("parts")).distinct()
    many = sizes.count() > 0

    def named(pairs: DataFrame, side: str, name: str) -> DataFrame:
        if not many:
            return pairs.join(salted.select(F.col("head").alias(side), F.col("id").alias(name)), side)
        split = pairs.join(sizes.withColumnRenamed("head", side), side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return split.join(salted.select(F.col("head").alias(side), "part", F.col("id").alias(name)), [side, "part"]).drop("part")

    across = named(named(links, "a", "x"), "b", "y").select("tab", "x", "y", "similarity")
    copies = salted.where("copies > 1")
    everywhere = copies.select("head", F.col("id").alias("y"), each.alias("part"))
    equal = copies.select("tab", "head", "part", F.col("id").alias("x")).join(everywhere, ["head", "part"]).where("x < y").select("tab", "x", "y", F.lit(1.0).alias("similarity"))
    return across.unionByName(equal).select(_table_name(specs).alias("table_name"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def _table_name(specs: list[Collection]) -> Column:
    return F.element_at(F.array(*[F.lit(c.name) for c in specs]), F.col("tab") + 1)


def similar_groups(tables: list[tuple[Collection, DataFrame]]) -> DataFrame:
    """(table_name, id, group_id, links) of every record that has a near-duplicate; group_id is the least id of its group.

    The groups are those of the classes, so no class is expanded; ``links`` counts the records that a record
    is linked with, its copies and the members of the classes linked with its own.
    """
    specs = [c for c, _ in tables]
    members, links = similar_classes(tables)
    classes = members.groupBy("tab", "head").agg(F.min("id").alias("name"), F.max("copies").alias("copies"))
    links = cut(links.select("tab", "a", "b"))
    both = links.unionByName(links.select("tab", F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(classes.select(F.col("head").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("beyond")).withColumnRenamed("a", "head")
    named = links.join(classes.select(F.col("head").alias("a"), F.col("name").alias("id_a")), "a").join(classes.select(F.col("head").alias("b"), F.col("name").alias("id_b")), "b")
    roots = components(named.select(F.col("tab").cast("string").alias("table_name"), "id_a", "id_b")).select(F.col("table_name").cast("int").alias("tab"), F.col("id").alias("name"), "group_id")
    known = classes.join(beyond, "head", "left").join(roots, ["tab", "name"], "left").where("copies > 1 or beyond is not null")
    told = known.select("head", F.coalesce("group_id", "name").alias("group_id"), (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("links"))
    return members.select("tab", "head", "id").join(told, "head").select(_table_name(specs).alias("table_name"), "id", "group_id", "links")


def components(pairs: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(table_name, id, group_id) of every id in (table_name, id_a, id_b): the connected groups; group_id is the least id.

    Alternates two steps that link every record to the least id it knows, each a join and an aggregation
    without collecting anyone's neighbours, until nothing changes.
    """
    edges = cut(pairs.select("table_name", F.col("id_b").alias("u"), F.col("id_a").alias("v")).distinct())
    ids = edges.select("table_name", F.col("u").alias("id")).unionByName(edges.select("table_name", F.col("v").alias("id"))).distinct()
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select("table_name", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("table_name", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, ["table_name", "u"]).where("v > u").select("table_name", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("table_name", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["table_name", "u"]).select("table_name", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(low.select("table_name", "u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("table_name", "u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the groups did not settle")
    roots = edges.select("table_name", F.col("u").alias("id"), F.col("v").alias("group_id"))
    return ids.join(roots, ["table_name", "id"], "left").select("table_name", "id", F.coalesce("group_id", "id").alias("group_id"))
