"""Problem 8: encoding a corpus with a public byte-level BPE, by speculation and verification.

A pre-token is first cut greedily into the longest vocabulary entries. That proposal is the exact
encoding if and only if every two neighbouring tokens are compatible, that is, if merging the bytes of
the two gives just these two tokens again. All pairs of a batch are tested together against a memo of
pairs; a pre-token with an incompatible pair goes through exact merging.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenising pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens and pairs that a worker remembers before it starts afresh.
MEMO_WORDS, MEMO_PAIRS = 300_000, 2_000_000


class SpeculativeBpe:
    """Encoder over a ``.tiktoken`` rank file; the ids are the ranks."""

    def __init__(self, ranks_path: str = DEFAULT_RANKS):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.words_of = regex.compile(PATTERN).findall
        self.words: dict[str, np.ndarray] = {}
        self.keys, self.verdicts = np.empty(0, np.int64), np.empty(0, bool)  # pairs tested so far, in order
        self.exact_merges = 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; the vocabulary holds every single byte, so it always ends."""
        get, longest, n, at, out = self.ranks.get, self.longest, len(word), 0, []
        while at < n:
            end = min(n, at + longest)
            while (token := get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: always merge the leftmost pair of lowest rank, in O(n log n)."""
        n = len(word)
        start, nxt, prv = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        end, alive = list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(left: int) -> None:
            right = nxt[left]
            if right < n and (rank := self.ranks.get(word[start[left] : end[right]])) is not None:
                heapq.heappush(heap, (rank, left, end[right]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, stop = heapq.heappop(heap)
            if not alive[left]:
                continue
            right = nxt[left]
            if right >= n or end[right] != stop:
                continue
            end[left], alive[right], nxt[left] = stop, False, nxt[right]
            if nxt[left] < n:
                prv[nxt[left]] = left
            offer(left)
            if prv[left] >= 0:
                offer(prv[left])
        return [self.ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each distinct pair key ``left << 32 | right``, in order, whether the two tokens can stand side by side.

        All pairs are looked up in one search among those tested before; each new pair is merged once.
        """
        if len(self.keys) > MEMO_PAIRS:
            self.keys, self.verdicts = self.keys[:0], self.verdicts[:0]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        out = np.zeros(len(keys), bool)
        out[known] = self.verdicts[at[known]]
        if not known.all():
            new, bytes_of = keys[~known], self.bytes_of
            pairs = zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist())
            out[~known] = np.fromiter((self.merge(bytes_of[a] + bytes_of[b]) == [a, b] for a, b in pairs), bool, len(new))
            self.keys, self.verdicts = np.insert(self.keys, at[~known], new), np.insert(self.verdicts, at[~known], out[~known])
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode the pre-tokens not seen before, all their neighbouring pairs in one test."""
        proposals: list[tuple[str, bytes, list[int]]] = []
        for word in words:
            raw = word.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.words[word] = np.array([whole], np.int32)
            else:
                proposals.append((word, raw, self.propose(raw)))
        if not proposals:
            return
        flat = np.fromiter((t for _, _, ids in proposals for t in ids), np.int64)
        owner = np.repeat(np.arange(len(proposals)), [len(ids) for _, _, ids in proposals])
        inner = owner[1:] == owner[:-1]
        keys, where = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        wrong = set(owner[1:][inner][~self.compatible(keys)[where]].tolist()) if len(keys) else set()
        for i, (word, raw, ids) in enumerate(proposals):
            if i in wrong:
                self.exact_merges += 1
                ids = self.merge(raw)
            self.words[word] = np.array(ids, np.int32)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; null and empty texts give an empty array."""
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        split = [self.words_of(t) if t else [] for t in texts]
        self.learn({w for ws in split for w in ws} - self.words.keys())
        memo, none = self.words, np.empty(0, np.int32)
        return [np.concatenate([memo[w] for w in ws]) if ws else none for ws in split]


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> SpeculativeBpe:
    """One encoder for each Python worker; a file that was sent with the job is preferred to one of that path."""
    sent = SparkFiles.get(os.path.basename(ranks_path)) if SparkFiles._is_running_on_worker else ranks_path
    return SpeculativeBpe(sent if os.path.exists(sent) else ranks_path)


def _sent(df: DataFrame, ranks_path: str) -> str:
    """``ranks_path``, after its file was sent to the executors, which need not have it."""
    context = df.sparkSession.sparkContext
    if os.path.exists(ranks_path) and not any(f.endswith("/" + os.path.basename(ranks_path)) for f in context.listFiles):
        context.addFile(ranks_path)
    return ranks_path


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_corpus(df: DataFrame, id_column: str, text_column: str, ranks_path: str = DEFAULT_RANKS, ids_column: str = "ids") -> DataFrame:
    """Columns ``id_column`` and ``ids_column`` (array<int>) for every row of ``df``, without a shuffle.

    Null texts and empty texts give an empty array. Strings of special tokens are ordinary text. Rows with
    a null id and repeated rows keep their own result row; other columns of ``df`` are not read.
    """
    id_type, ranks_path = dict(df.dtypes)[id_column], _sent(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for whole in batches:
            for batch in _slices(whole):
                ids = bpe.encode_batch(batch.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_column, ids_column])

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {id_type}, `{ids_column}` array<int>")


def count_tokens(df: DataFrame, id_column: str, text_column: str, ranks_path: str = DEFAULT_RANKS, count_column: str = "n_tokens", carried: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`encode_corpus`, but with the number of tokens (bigint; 0 for null and empty texts) and the columns ``carried``."""
    types, ranks_path = dict(df.dtypes), _sent(df, ranks_path)
    kept = (id_column, *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for whole in batches:
            for batch in _slices(whole):
                n = [len(x) for x in bpe.encode_batch(batch.column(len(kept)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(n, pa.int64())], names=[*kept, count_column])

    return df.select(*kept, text_column).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{count_column}` bigint"]))
