"""Exact nearest vectors by a block matrix join.

Home blocks stay in one task and visiting vectors stream past them. The product of int8 codes, with a bound on
the quantisation error of each entry, tells which pairs can still be among the k best; only these are computed
again in double precision, and the best of each row are kept in bounded arrays. A task holds one home block and
one strip of a product, however many vectors visit it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of one product that are held at once, and pairs computed again at once.
STRIP_ENTRIES, PAIRS_AT_ONCE = 1 << 23, 16_384
FOUND = "owner_kind string, id string, found array<struct<similarity: double, neighbour: string>>"
_BEST = pa.list_(pa.struct([("similarity", pa.float64()), ("neighbour", pa.string())]))
_NONE = -9.0


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and norm of the error of each row."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


class Block:
    """Vectors with their ids and the int8 codes of their unit vectors."""

    def __init__(self, ids: list[str], x: np.ndarray):
        self.ids = np.array([i.encode() for i in ids], "S")
        self.raw = np.ascontiguousarray(x, np.float32)
        parts = [self._codes(self.raw[at : at + PAIRS_AT_ONCE]) for at in range(0, len(x), PAIRS_AT_ONCE)]
        self.norm, self.codes, self.scale, self.error = (np.concatenate(p) for p in zip(*parts))

    @staticmethod
    def _codes(raw: np.ndarray) -> tuple[np.ndarray, ...]:
        x = raw.astype(np.float64)
        norm = np.maximum(np.linalg.norm(x, axis=1), 1e-30)
        codes, scale, error = quantise(x / norm[:, None])
        return norm, codes, scale.astype(np.float32), error.astype(np.float32)

    def __len__(self) -> int:
        return len(self.ids)

    def unit(self, rows: np.ndarray) -> np.ndarray:
        return self.raw[rows].astype(np.float64) / self.norm[rows, None]


def cosines(a: Block, i: np.ndarray, b: Block, j: np.ndarray, digits: int) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", a.unit(i[at : at + PAIRS_AT_ONCE]), b.unit(j[at : at + PAIRS_AT_ONCE])) for at in range(0, len(i), PAIRS_AT_ONCE)]
    return np.round(np.concatenate(parts), digits) if parts else np.empty(0)


def reached(lower: np.ndarray, k: int, axis: int) -> np.ndarray:
    """A value that at least k entries along ``axis`` reach; -9 where there are fewer than k.

    The k-th greatest of the maxima of disjoint parts, which costs one pass.
    """
    n = lower.shape[axis]
    if n < k or 0 in lower.shape:
        return np.full(lower.shape[1 - axis], _NONE, np.float32)
    parts = min(n, 16 * k)
    top = np.maximum.reduceat(lower, np.arange(parts) * n // parts, axis=axis)
    return np.partition(top, parts - k, axis=axis).take(parts - k, axis=axis)


def first_of_rows(rows: np.ndarray, worth: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each row, in order: greatest worth, then least name. However many tie, k are left."""
    order = np.lexsort((names, -worth, rows))
    ordered = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.empty(0, int)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]]).astype(int)))
    return order[place < k]


class Best:
    """The k best partners found so far of each row."""

    def __init__(self, n: int, k: int):
        self.k, self.worth, self.names = k, np.full((n, k), _NONE), np.full((n, k), b"", "S1")

    @property
    def floor(self) -> np.ndarray:
        return self.worth[:, -1].astype(np.float32)

    def offer(self, rows: np.ndarray, worth: np.ndarray, names: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        old = self.worth[touched].reshape(-1)
        kept = old > _NONE
        rows = np.concatenate([np.repeat(touched, self.k)[kept], rows])
        worth, names = np.concatenate([old[kept], worth]), np.concatenate([self.names[touched].reshape(-1)[kept], names])
        chosen = first_of_rows(rows, worth, names, self.k)
        rows, worth, names = rows[chosen], worth[chosen], names[chosen]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(rows)]])))
        if names.dtype.itemsize > self.names.dtype.itemsize:
            self.names = self.names.astype(names.dtype)
        self.worth[rows, place], self.names[rows, place] = worth, names

    def batch(self, kind: str, ids: np.ndarray) -> pa.RecordBatch:
        """One row for each row with a partner."""
        full = self.worth > _NONE
        counts = full.sum(axis=1)
        rows = np.flatnonzero(counts)
        text = lambda names: pa.array([n.decode() for n in names.tolist()], pa.string())
        items = pa.StructArray.from_arrays([pa.array(self.worth[full] + 0.0), text(self.names[full])], names=["similarity", "neighbour"])
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[rows])]), pa.int32()), items)
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), text(ids[rows]), found.cast(_BEST)], names=["owner_kind", "id", "found"])


class Home:
    """A block at home in a task with the best partners of its rows."""

    def __init__(self, block: Block, k: int, digits: int, mutual: bool):
        self.block, self.k, self.digits = block, k, digits
        self.wide = block.codes.astype(np.float32).T
        self.slack = np.float32(2 * 10.0**-digits + 2e-6)  # rounding to digits and to float32
        self.rows = max(1, min(4096, STRIP_ENTRIES // max(1, len(block))))
        self.best = Best(len(block), k)
        if mutual:
            for at in range(0, len(block), self.rows):
                self._strip(block, slice(at, at + self.rows), None, at)

    def visit(self, block: Block, mutual: bool) -> Best | None:
        """Lets a block pass; with ``mutual`` the best partners of its rows are returned."""
        theirs = Best(len(block), self.k) if mutual else None
        for at in range(0, len(block), self.rows):
            self._strip(block, slice(at, at + self.rows), theirs, None)
        return theirs

    def _strip(self, other: Block, rows: slice, theirs: Best | None, own: int | None) -> None:
        # products of codes are exact in float32 (128 * 127 * 127 < 2**24)
        value = other.codes[rows].astype(np.float32) @ self.wide
        value *= other.scale[rows, None]
        value *= self.block.scale
        error = other.error[rows, None]
        bound = (1 + error) * self.block.error + (error + self.slack)
        if own is not None:  # the block with itself: each row meets all others, once
            mine = np.arange(len(value))
            value[mine, mine + own] = _NONE
            i, j = self._above(value, bound, reached(value - bound, self.k, 1)[:, None])
            self.best.offer(i + own, cosines(other, i + own, self.block, j, self.digits), self.block.ids[j])
            return
        lower = value - bound if theirs is not None or (self.best.floor <= -2).any() else None
        if theirs is not None:
            i, j = self._above(value, bound, reached(lower, self.k, 1)[:, None])
            theirs.offer(i + rows.start, cosines(other, i + rows.start, self.block, j, self.digits), self.block.ids[j])
        floor = self.best.floor
        if (floor <= -2).any():
            floor = np.maximum(floor, reached(lower, self.k, 0))
        i, j = self._above(value, bound, floor)
        self.best.offer(j, cosines(other, i + rows.start, self.block, j, self.digits), other.ids[i + rows.start])

    @staticmethod
    def _above(value: np.ndarray, bound: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # places without a vector hold -9
        return np.nonzero((value + bound >= floor) & (value > -2))


def block_join(rows: DataFrame, tasks: int, k: int, digits: int, mutual: bool) -> DataFrame:
    """FOUND rows: for each home row its k best visitors and, with ``mutual``, for each visitor its k best home rows.

    ``rows`` has task (int), home (int, unique within a task), role (0 at home, 1 visiting), owner_kind, id and
    embedding (array<float>, all of one length; rows without one are left out). Rows at home of a mutual join are also compared with each
    other. In a join that isn't mutual visitors of several kinds may come; the home rows get k of each kind.
    The best of a row come from several tasks and are to be merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str] = []
        parts: list[np.ndarray] = []
        home: Home | None = None
        where, kind = None, None

        def settle() -> Home | None:
            if not ids:
                return None
            block = Block(ids, np.concatenate(parts))
            ids.clear()
            parts.clear()
            return Home(block, k, digits, mutual)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place, role, kinds, names = (batch.column(i).to_pylist() for i in range(4))
            if mutual:
                place = list(zip(place, kinds))
            x = np.asarray(batch.column(4).flatten(), np.float32).reshape(n, -1)
            at = 0
            while at < n:
                end = at + 1
                while end < n and place[end] == place[at] and role[end] == role[at] and kinds[end] == kinds[at]:
                    end += 1
                if place[at] != where:
                    home = home or settle()
                    if home is not None:
                        yield home.best.batch(kind, home.block.ids)
                    home, where, kind = None, place[at], kinds[at] if mutual else None
                if role[at] == 0:
                    ids += names[at:end]
                    parts.append(x[at:end].copy())
                else:
                    home = home or settle()
                    if home is not None:
                        if not mutual and kinds[at] != kind:
                            if kind is not None:
                                yield home.best.batch(kind, home.block.ids)
                                home.best = Best(len(home.block), k)
                            kind = kinds[at]
                        visitors = Block(names[at:end], x[at:end])
                        theirs = home.visit(visitors, mutual)
                        if theirs is not None:
                            yield theirs.batch(kinds[at], visitors.ids)
                at = end
        home = home or settle()
        if home is not None and (mutual or kind is not None):
            yield home.best.batch(kind, home.block.ids)

    order = ("home", "owner_kind", "role") if mutual else ("home", "role", "owner_kind")
    placed = rows.where("embedding is not null").repartitionById(tasks, "task").sortWithinPartitions(*order)
    return placed.select("home", "role", "owner_kind", "id", "embedding").mapInArrow(run, FOUND)


def merged(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, neighbour, similarity, position): the k best of the rows of FOUND; at most k come from each task."""
    items = found.select(*keys, F.explode("found").alias("f"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("f.similarity")).alias("s"), F.col("f.neighbour").alias("n"))))
    best = items.groupBy(*keys).agg(F.slice(ordered, 1, k).alias("best"))
    return best.select(*keys, F.posexplode("best").alias("position", "b")).select(*keys, F.col("b.n").alias("neighbour"), (0.0 - F.col("b.s")).alias("similarity"), (F.col("position") + 1).alias("position"))
