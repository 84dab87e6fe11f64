"""Problem 2: cutting oversized texts at natural boundaries, guided by lexical cohesion.

The coarsest kind of boundary at which every unit fits gives the possible cuts. Over the stream of words
two neighbouring blocks of words slide along; where their similarity has a deep valley the topic changes.
Within each window of admissible sizes the cut goes into the deepest valley.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import newest

LEVELS = ("paragraph", "line", "sentence", "word", "none")
LIMIT_BYTES, OVERLAP_BYTES = 8000, 200
#: Words in each of the two sliding blocks, and the least part of the limit that a piece should fill.
BLOCK_WORDS, LEAST_FILL = 60, 0.5
_WORD = re.compile(r"\w+")
#: Where a cut may fall: the matched characters stay between the two pieces.
_CUTS = {"paragraph": re.compile(r"\n\n"), "line": re.compile(r"\n"), "sentence": re.compile(r"\n|(?<=[.!?]) "), "word": re.compile(r"[\n ]")}


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    overlap: int
    text: str


def byte_offsets(text: str) -> np.ndarray:
    """Number of UTF-8 bytes before each character, and of all at the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])


def units(text: str, level: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in characters) of the units of a level."""
    spans = [m.span() for m in _CUTS[level].finditer(text)]
    starts = np.array([0] + [b for _, b in spans], np.int64)
    ends = np.array([a for a, _ in spans] + [len(text)], np.int64)
    return starts, ends


def small_units(text: str, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Units for a text with an unbroken part over ``limit``: its words with the space after them, that part by its characters.

    Characters are grapheme clusters, unless one of these is over the limit itself.
    """
    starts = units(text, "word")[0]
    ends = np.concatenate([starts[1:], [len(text)]])
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if offsets[b] - offsets[a] <= limit:
            out.append(np.array([a]))
            continue
        part = text[a:b]
        places = np.arange(a, b) if part.isascii() else np.array([a + m.start() for m in regex.finditer(r"\X", part)])
        sizes = offsets[np.concatenate([places[1:], [b]])] - offsets[places]
        out.append(places if sizes.max() <= limit else np.arange(a, b))
    starts = np.concatenate(out)
    return starts, np.concatenate([starts[1:], [len(text)]])


def boundary_level(text: str, offsets: np.ndarray, limit: int = LIMIT_BYTES) -> str:
    """The first level of LEVELS at which no unit is larger than ``limit`` bytes."""
    for level in LEVELS[:-1]:
        starts, ends = units(text, level)
        if (offsets[ends] - offsets[starts]).max() <= limit:
            return level
    return "none"


def cohesion(words: list[str], block: int = BLOCK_WORDS) -> np.ndarray:
    """Cosine of the word counts of the ``block`` words before and after each gap; O(1) a step."""
    n = len(words)
    out = np.ones(n + 1)
    left, right = Counter(), Counter(words[:block])
    dot, left_sq, right_sq = 0, 0, sum(v * v for v in right.values())
    window: deque[str] = deque()
    for gap in range(1, n):
        moved = words[gap - 1]
        # ``moved`` leaves the right block and joins the left one
        dot -= left[moved]
        right_sq -= 2 * right[moved] - 1
        right[moved] -= 1
        dot += right[moved]
        left_sq += 2 * left[moved] + 1
        left[moved] += 1
        window.append(moved)
        if len(window) > block:
            gone = window.popleft()
            dot -= right[gone]
            left_sq -= 2 * left[gone] - 1
            left[gone] -= 1
        if gap - 1 + block < n:
            new = words[gap - 1 + block]
            dot += left[new]
            right_sq += 2 * right[new] + 1
            right[new] += 1
        out[gap] = dot / (left_sq * right_sq) ** 0.5 if left_sq and right_sq else 1.0
    return out


def valley_depths(similarity: np.ndarray) -> np.ndarray:
    """How far each value lies below the peaks that are climbed to its left and right."""
    n = len(similarity)
    left, right = similarity.copy(), similarity.copy()
    for i in range(1, n):
        if similarity[i - 1] >= similarity[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if similarity[i + 1] >= similarity[i]:
            right[i] = right[i + 1]
    return left + right - 2 * similarity


def split_text(text: str, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> tuple[str, list[Piece]]:
    """The boundary used and the pieces; a text within the limit is one piece.

    Piece i covers the characters start..end, with ``overlap`` characters of the end of the piece before in
    front; only the separators at the cuts lie between pieces, so text[start:end] of all pieces, with these
    separators, are the text again. Each piece has at most ``limit`` bytes; the overlap has at most
    ``overlap`` bytes, fewer where a unit leaves no room.
    """
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    offsets = byte_offsets(text)
    level = boundary_level(text, offsets, limit)
    if offsets[-1] <= limit:
        return level, [Piece(0, len(text), 0, text)]
    starts, ends = units(text, level) if level != "none" else small_units(text, offsets, limit)
    marks = [m.start() for m in _WORD.finditer(text)]
    similarity = cohesion([m.group().lower() for m in _WORD.finditer(text)])
    depth = valley_depths(similarity[np.searchsorted(marks, ends)])
    if level == "none":  # a cut inside a word is the last resort
        inside = (ends < len(text)) & ~np.isin(ends, units(text, "word")[0])
        depth[inside] = -1.0
    until = offsets[ends]
    next_start = np.concatenate([starts[1:], [len(text)]])
    pieces: list[Piece] = []
    unit, begin = 0, 0
    while unit < len(ends):
        reserve = overlap if pieces else 0
        # the last unit that fits, with room for the overlap if there is any such unit
        last = int(np.searchsorted(until, offsets[begin] + limit - reserve, "right")) - 1
        if last < unit:
            last = int(np.searchsorted(until, offsets[begin] + limit, "right")) - 1
        if last < len(ends) - 1:
            first = int(np.searchsorted(until, offsets[begin] + int(limit * LEAST_FILL), "left"))
            first = min(max(first, unit), last)
            window = depth[first : last + 1]
            last = first + int(np.flatnonzero(window == window.max())[-1])
        end = int(ends[last])
        room = min(overlap, limit - int(offsets[end] - offsets[begin]))
        prefix = 0
        if pieces:
            previous = pieces[-1]
            from_ = int(np.searchsorted(offsets, offsets[previous.end] - room, "left"))
            prefix = previous.end - max(from_, previous.start)
        head = text[pieces[-1].end - prefix : pieces[-1].end] if prefix else ""
        pieces.append(Piece(begin, end, prefix, head + text[begin:end]))
        unit, begin = last + 1, int(next_start[last])
    return level, pieces


_PIECES = "id string, piece_no int, boundary string, start_char int, end_char int, overlap_chars int, n_bytes int, piece string"


def split_oversized(df: DataFrame, id_column: str = "id", text_column: str = "text_content", order_column: str = "updated_at", limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """Pieces of every record whose text has more than ``limit`` bytes; the others give no rows.

    A record delivered more than once counts in its newest row. Null and empty texts have no pieces. Only
    oversized texts are shuffled. Ids are read as strings; null ids form one record. Columns of ``df`` with
    other names are not read.
    """
    large = F.when(F.octet_length(text_column) > limit, F.col(text_column))
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(order_column).alias("__order"), large.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                level, pieces = split_text(text, limit, overlap)
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * n, pa.string()),
                        pa.array(range(n), pa.int32()),
                        pa.array([level] * n, pa.string()),
                        pa.array([p.start for p in pieces], pa.int32()),
                        pa.array([p.end for p in pieces], pa.int32()),
                        pa.array([p.overlap for p in pieces], pa.int32()),
                        pa.array([len(p.text.encode()) for p in pieces], pa.int32()),
                        pa.array([p.text for p in pieces], pa.string()),
                    ],
                    names=["id", "piece_no", "boundary", "start_char", "end_char", "overlap_chars", "n_bytes", "piece"],
                )

    return newest(rows, "id", "__order", "text").where("text is not null").mapInArrow(run, _PIECES)
