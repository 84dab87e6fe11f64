"""Problem 1: the main body of web pages, from flat text blocks.

A page is a sequence of flat text blocks. Each block is described by its number of words and link density,
those of the two blocks on either side, and the kind of element that it stood in; a decision tree trained on
the small labelled table of ``labelled.py`` tells main body from the rest. Nothing is known of the wording.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.labelled import PAGES
from quern.runtime import newest

if TYPE_CHECKING:
    from quern.llm.residue import ResidueIndex

#: Elements that end a text block, and those without text. Cells of a row are one block.
BLOCK_ELEMENTS = frozenset("address article aside blockquote body br button caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody tfoot thead tr ul".split())
SILENT_ELEMENTS = frozenset("script style noscript template head title iframe svg".split())
#: Kinds of elements, from plain containers to those that hold little else than content.
KINDS = {"li": 1.0, "dd": 1.0, "td": 2.0, "th": 2.0, "p": 3.0, "blockquote": 4.0, "pre": 4.0, "dt": 4.0, "figcaption": 4.0, "caption": 4.0, "h1": 5.0, "h2": 5.0, "h3": 5.0, "h4": 5.0, "h5": 5.0, "h6": 5.0}
_LETTERS = {"d": 0.0, "m": 0.0, "l": 1.0, "t": 2.0, "p": 3.0, "q": 4.0, "h": 5.0}
#: Neighbours on either side, and the features of a block; bare text has no element.
REACH = 2
FEATURES = ("words_2_before", "words_before", "words", "words_after", "words_2_after", "links_2_before", "links_before", "links", "links_after", "links_2_after", "element")
_HTML = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|([^<]+)|<", re.DOTALL)
_WORDS = re.compile(r"\w+")
_MARKS = re.compile(r"(?<=\s)[|·›»](?=\s)")
_SENTENCE_END = re.compile(r"[.!?…:;]['\"”»’)]*$|[.!?…] ?\([^)]*\)$")


@dataclass
class Block:
    """One text block: its text, number of words, the share of it inside links and the kind of its element."""

    text: str
    words: int
    links: float = 0.0
    element: float = 0.0


def html_blocks(source: str) -> list[Block]:
    """Flat text blocks of a page in order; unclosed and unknown elements do no harm."""
    blocks: list[Block] = []
    parts: list[str] = []
    inside = linked = total = 0
    silent, element = "", ""

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, len(_WORDS.findall(text)), linked / total if total else 0.0, KINDS.get(element, 0.0)))
            parts.clear()
        linked = total = 0

    for m in _HTML.finditer(source):
        text = m.group(3)
        if text is not None:
            if not silent:
                parts.append(text)
                n = len(text.strip())
                total += n
                if inside:
                    linked += n
            continue
        name = (m.group(2) or "").lower()
        if silent:
            if m.group(1) and name == silent:
                silent = ""
        elif name in SILENT_ELEMENTS:
            silent = "" if m.group(1) else name
        elif name == "a":
            inside = max(0, inside + (-1 if m.group(1) else 1))
        elif name == "td" or name == "th":
            parts.append(" ")
            element = element if m.group(1) else name
        elif name in BLOCK_ELEMENTS:
            flush()
            element = "" if m.group(1) else name
    flush()
    return blocks


def link_likeness(line: str) -> float:
    """Stand-in for the link density of a line whose HTML is unknown: 1 for labels between marks, 0 for sentences, else 0.5."""
    return 1.0 if _MARKS.search(line) else 0.0 if _SENTENCE_END.search(line) else 0.5


def line_blocks(text: str) -> tuple[list[int], list[Block]]:
    """Numbers and blocks of the lines with text."""
    numbers, blocks = [], []
    for i, line in enumerate(text.split("\n")):
        if key := " ".join(line.split()):
            numbers.append(i)
            blocks.append(Block(key, len(_WORDS.findall(key)), link_likeness(key)))
    return numbers, blocks


def aligned(lines: list[Block], blocks: list[Block]) -> list[int]:
    """For each line the place of the block with its text, in the order of both; -1 where there is none.

    Of several blocks with one text a line takes the first one after that of the line before.
    """
    places: dict[str, list[int]] = defaultdict(list)
    for i, b in enumerate(blocks):
        places[b.text].append(i)
    out, at = [], 0
    for line in lines:
        found = places.get(line.text)
        if found is None:
            out.append(-1)
            continue
        place = next((i for i in found if i >= at), found[-1])
        out.append(place)
        at = max(at, place + 1)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; beyond the ends of a page lie blocks without words."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    if n:
        words = np.pad(np.array([b.words for b in blocks], float), REACH)
        links = np.pad(np.array([b.links for b in blocks], float), REACH)
        for i in range(2 * REACH + 1):
            out[:, i], out[:, 2 * REACH + 1 + i] = words[i : i + n], links[i : i + n]
        out[:, -1] = [b.element for b in blocks]
    return out


@dataclass
class DecisionTree:
    """A binary classification tree (Gini impurity, axis-parallel cuts) in flat arrays."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def _node(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.feature)
        for column, value in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.share, float(y.mean()))):
            column.append(value)
        if depth == 0 or y.min() == y.max():
            return me
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            ones, count = np.cumsum(t), np.arange(1, len(t) + 1)
            p, q = ones / count, (ones[-1] - ones) / np.maximum(len(t) - count, 1)
            impurity = count * 2 * p * (1 - p) + (len(t) - count) * 2 * q * (1 - q)
            allowed = np.flatnonzero((v[:-1] < v[1:]) & (count[:-1] >= least) & (len(t) - count[:-1] >= least))
            if len(allowed):
                i = allowed[impurity[allowed].argmin()]
                if impurity[i] < best[0]:
                    best = (float(impurity[i]), f, float(v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            below = x[:, best[1]] <= best[2]
            self.feature[me], self.threshold[me] = best[1], best[2]
            self.left[me] = self._node(x[below], y[below], depth - 1, least)
            self.right[me] = self._node(x[~below], y[~below], depth - 1, least)
        return me

    def rules(self, names: tuple[str, ...] = FEATURES, node: int = 0, indent: str = "") -> str:
        """The tree as text."""
        if self.feature[node] < 0:
            return f"{indent}main {self.share[node]:.2f}\n"
        test = f"{indent}{names[self.feature[node]]} <= {self.threshold[node]:g}"
        return f"{test}\n{self.rules(names, self.left[node], indent + '  ')}{indent}else\n{self.rules(names, self.right[node], indent + '  ')}"

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 6) -> DecisionTree:
        tree = cls()
        tree._node(x, y.astype(float), depth, least)
        return tree

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of the positive class in the leaf of each row."""
        at = np.zeros(len(x), int)
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, rows = np.array(self.left), np.array(self.right), np.arange(len(x))
        for _ in range(64):
            f = feature[at]
            if (f < 0).all():
                break
            go = np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
            at = np.where(f < 0, at, go)
        return np.array(self.share)[at]


_ITEM = re.compile(r"([+-])([a-z])(\d+)(?::(\d+))?(?:\*(\d+))?$")


def labelled_table(known: bool, pages: Iterable[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages, with what the HTML tells or as bare text."""
    xs, ys = [], []
    for page in pages or PAGES.strip().split("\n"):
        blocks, labels = [], []
        for item in page.split():
            label, kind, words, links, times = _ITEM.match(item).groups()
            density = int(links or 0) / 100 if known else 1.0 if kind == "m" else 0.5 if kind in "ht" or int(words) < 9 else 0.0
            blocks += [Block("", int(words), density, _LETTERS[kind])] * int(times or 1)
            labels += [label == "+"] * int(times or 1)
        xs.append(features(blocks))
        ys.append(np.array(labels))
    x = np.concatenate(xs)
    return (x if known else x[:, :-1]), np.concatenate(ys)


@dataclass
class BodyModel:
    """The tree for blocks whose HTML is known and the one for bare text."""

    structural: DecisionTree
    textual: DecisionTree


def train() -> BodyModel:
    """The trees of the labelled pages; it takes some milliseconds on the driver."""
    return BodyModel(DecisionTree.fit(*labelled_table(True)), DecisionTree.fit(*labelled_table(False)))


def other_lines(model: BodyModel, text: str | None, *sources: str | None) -> list[int]:
    """Numbers of the non-empty lines of ``text`` that are not main body.

    A line is judged as the block of the HTML that it comes from; a source is only parsed while lines are
    still unknown to those before it. Lines that no source holds are judged as bare text.
    """
    if not text:
        return []
    numbers, lines = line_blocks(text)
    if not lines:
        return []
    main = np.full(len(lines), -1)
    for source in sources:
        if source and (main < 0).any():
            blocks = html_blocks(source)
            place = np.array(aligned(lines, blocks))
            new = (main < 0) & (place >= 0)
            if new.any():
                main[new] = (model.structural.predict(features(blocks)) >= 0.5)[place[new]]
    if (bare := main < 0).any():
        main[bare] = (model.textual.predict(features(lines)[:, :-1]) >= 0.5)[bare]
    return [i for i, m in zip(numbers, main.tolist()) if not m]


def main_text(text: str, others: list[int]) -> str:
    """``text`` without the given lines; rows of empty lines shrink to one."""
    gone = set(others)
    kept = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
    return re.sub(r"\n{3,}", "\n\n", kept).strip("\n")


def extract(df: DataFrame, index: ResidueIndex, trees: BodyModel | None = None, id_column: str = "id", order_column: str = "updated_at", with_text: bool = False) -> DataFrame:
    """(id, other_lines[, main]) of every page with text, in the newest row of each record.

    ``df`` has raw_html, clean_html and text_content. Pages without text, and those whose text is residue by
    ``index``, give no row. Where both HTML columns are null the lines are judged by their numbers of words alone.
    Null ids form one record; other columns are not read.
    """
    context = df.sparkSession.sparkContext
    model = context.broadcast((trees or train(), index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, known = model.value
        for batch in batches:
            rows, bodies = [], []
            for raw, clean, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                found = None if not text or known.text_is_residue(text) else other_lines(judge, text, raw, clean)
                rows.append(found)
                bodies.append(main_text(text, found) if with_text and found is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32())), pa.array(bodies, pa.string())], names=["id", "order", "other_lines", "main"])

    chosen = df.select(F.col(id_column).cast("string").alias("id"), F.col(order_column).cast("timestamp").alias("order"), "raw_html", "clean_html", "text_content")
    judged = chosen.mapInArrow(run, "id string, order timestamp, other_lines array<int>, main string")
    columns = ("other_lines", "main") if with_text else ("other_lines",)
    return newest(judged, "id", "order", *columns).where("other_lines is not null")
