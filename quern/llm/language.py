"""Problem 10: language of documents and of their lines, words first, shorter character n-grams after.

A word that the model knows is scored by its log frequency in each language. An unseen word falls back
to the longest of its character n-grams (five characters down to one) that are known. A line of which too few
words are known in the language that fits best is in none of the languages.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut

#: Fixed value: the languages that labels can name.
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru")
#: Labels that say nothing, besides null and blank.
NO_LABEL = ("und", "n/a", "")
MAX_GRAM = 5
BACKOFF_WEIGHT = 0.35
#: Weight of the document's own language when one of its lines is judged.
CONTEXT_WEIGHT = 0.7
#: Words known in its language, or else trigrams at home there, that a text or line needs; without either it is UNKNOWN.
LEAST_KNOWN, LEAST_FIT, FIT_GRAM, UNKNOWN = 0.2, 0.72, 3, "unknown"
_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"[^\W_]+")
#: Characters without a look or a width, which may stand inside a word; not those that end lines or part words.
_INVISIBLE = re.compile("[\x00-\x08\x0e-\x1b\x7f\xad\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]")
#: Letters that the languages are written with: Latin and Cyrillic.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏЀ-ӿ]+")


def label_language(label: Column) -> Column:
    """The label in lower case up to the first ``-`` or ``_``; null where it names none."""
    short = F.trim(F.lower(F.regexp_extract(label, r"^([^-_]*)", 1)))
    return F.when(short.isin(*NO_LABEL) | (F.trim(F.lower(label)).isin(*NO_LABEL)), None).otherwise(short)


@dataclass
class LanguageModel:
    """Log-frequency vectors (one number for each language, mean 0) of words and of n-grams, and where each word is at home."""

    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    home: np.ndarray

    def evidence(self, word: str) -> np.ndarray:
        """Evidence of one lower-case word of letters; zeros when nothing of it is known."""
        row = self.words.get(word)
        if row is not None:
            return self.table[row]
        padded = f"^{word}$"
        for n in range(min(MAX_GRAM, len(padded)), 0, -1):
            rows = [r for i in range(len(padded) - n + 1) if (r := self.grams.get(padded[i : i + n])) is not None]
            if rows:
                return np.add.reduce(self.table.take(rows, 0), 0) * (BACKOFF_WEIGHT / len(rows))
        return np.zeros(len(LANGUAGES))

    def known(self, word: str) -> np.ndarray:
        """In which languages the word is known."""
        row = self.words.get(word)
        return self.home[row] if row is not None else np.zeros(len(LANGUAGES))

    def fit(self, words: list[str], language: int) -> float:
        """Which part of the words is at home in a language; of a word that is not known, which part of its trigrams."""
        total = 0.0
        for word in words:
            if (row := self.words.get(word)) is not None:
                total += self.home[row, language]
            else:
                padded = f"^{word}$"
                grams = [padded[i : i + FIT_GRAM] for i in range(len(padded) - FIT_GRAM + 1)]
                total += sum(self.home[r, language] for g in grams if (r := self.grams.get(g)) is not None) / max(1, len(grams))
        return total / max(1, len(words))


class _Vocabulary(dict):
    """Numbers of the runs of letters and digits met so far; what each of them says is worked out once."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.evidence, self.known = (np.zeros((1024, len(LANGUAGES))) for _ in range(2))
        self.parts, self.letters = (np.zeros(1024, np.int64) for _ in range(2))

    def __missing__(self, run: str) -> int:
        number = len(self)
        if number == len(self.parts):
            self.evidence, self.known, self.parts, self.letters = (np.concatenate([t, np.zeros_like(t)]) for t in (self.evidence, self.known, self.parts, self.letters))
        words = [run] if run.isalpha() else _LETTERS.findall(run)
        for word in words:
            self.evidence[number] += self.model.evidence(word)
            if word in self.model.words:
                self.known[number] += self.model.known(word)
        self.parts[number] = len(words)
        self.letters[number] = len(run) if _WORD.fullmatch(run) else 0
        self[run] = number
        return number


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample_rows(df: DataFrame, id_column: str, label_column: str, rows_per_label: int) -> DataFrame:
    """(label, id) of at most ``rows_per_label`` labelled rows a language, least hash of the id first."""
    labelled = df.select(label_language(F.col(label_column)).alias("label"), F.col(id_column).alias("id")).where(F.col("label").isin(*LANGUAGES))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    return labelled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_label).select("id", "label")


def _fit(counts: list[tuple[str, str, int]]) -> LanguageModel:
    """Model from (language, word, count); frequencies are taken within each language, so sizes don't matter."""
    column = {lang: i for i, lang in enumerate(LANGUAGES)}
    word_counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
    for lang, word, n in counts:
        word_counts[word][column[lang]] += n
    gram_counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
    for word, row in word_counts.items():
        padded, weight = f"^{word}$", np.log1p(row)
        for n in range(1, MAX_GRAM + 1):
            for i in range(len(padded) - n + 1):
                gram_counts[padded[i : i + n]] += weight

    def table(entries: dict[str, np.ndarray], prior: float) -> tuple[list[str], np.ndarray]:
        names = list(entries)
        matrix = np.array([entries[k] for k in names]) if names else np.zeros((0, len(LANGUAGES)))
        totals = np.maximum(matrix.sum(axis=0), 1.0)
        logs = np.log(matrix / totals + prior)
        return names, logs - logs.mean(axis=1, keepdims=True)

    words, word_table = table(word_counts, 2e-5)
    keep = {k: v for k, v in gram_counts.items() if v.sum() >= 2 * math.log(2)}
    grams, gram_table = table(keep, 1e-4)
    # a word or n-gram is at home where it has at least a tenth of the share that it has in the language that it fits best
    every = np.vstack([word_table, gram_table])
    home = (every >= every.max(axis=1, keepdims=True) - math.log(10)).astype(np.float32)
    return LanguageModel({w: i for i, w in enumerate(words)}, {g: len(words) + i for i, g in enumerate(grams)}, every, home)


def train(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", rows_per_label: int = 1500, words_per_label: int = 20_000) -> LanguageModel:
    """Fit on a bounded sample: at most ``rows_per_label`` labelled rows and ``words_per_label`` words a language.

    The labels may be partly wrong: after a first fit the lines of the sample are counted again under the
    language that the first model gives them. Without any usable label the model knows nothing.
    """
    ids = sample_rows(df, id_column, label_column, rows_per_label)
    sample = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null").join(F.broadcast(ids), "id")
    visible = F.regexp_replace("text", _INVISIBLE.pattern, "")  # of the sample alone
    lines = cut(sample.select("label", F.explode(F.split(visible, "\n")).alias("line")).where("trim(line) <> ''"))

    def count(labelled: DataFrame) -> list[tuple[str, str, int]]:
        words = labelled.select("label", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        counted = words.groupBy("label", "word").count().where("count >= 2")
        order = Window.partitionBy("label").orderBy(F.col("count").desc(), "word")
        top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= words_per_label)
        return [(r.label, r.word, r["count"]) for r in top.select("label", "word", "count").collect()]

    first = _fit(count(lines))

    def relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(first)
        for batch in batches:
            labels = [lang if lang != UNKNOWN else None for lang, _, _ in judge.documents(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), batch.column(0)], names=["label", "line"])

    return _fit(count(lines.select("line").mapInArrow(relabel, "label string, line string").where("label is not null")))


def countable(line: str, least_words: int = 4) -> bool:
    """Whether a line has enough words of letters alone, in a script of the languages, and is no code, address, number or row of symbols.

    A word is a run of letters and digits. Most of the line must be in such words. Invisible characters don't count.
    """
    line = _INVISIBLE.sub("", line)
    words = [w for w in _RUNS.findall(line) if _WORD.fullmatch(w)]
    return len(words) >= least_words and sum(map(len, words)) >= 0.6 * len("".join(line.split()))


Judgement = tuple[str | None, float, list[tuple[int, str, float]]]


class Judge:
    """Judges batches of texts; all words of a batch are looked up once and added up as one matrix."""

    def __init__(self, model: LanguageModel, most_words: int = 200_000):
        self.model, self.most, self.vocabulary = model, most_words, _Vocabulary(model)

    def documents(self, texts: list[str | None], least_words: int = 4) -> list[Judgement]:
        """Language and confidence of each text, and (line_no, language, confidence) of its countable lines."""
        if len(self.vocabulary) > self.most:
            self.vocabulary = _Vocabulary(self.model)
        runs: list[str] = []
        sizes, numbers, owners, letters = [], [], [], []
        for d, text in enumerate(texts):
            if not text:
                continue
            clean = _INVISIBLE.sub("", text) if not text.isascii() or _INVISIBLE.search(text) else text
            for number, line in enumerate(clean.lower().split("\n")):
                if found := _RUNS.findall(line):
                    runs += found
                    sizes.append(len(found))
                    numbers.append(number)
                    owners.append(d)
                    letters.append(len(line) - line.count(" ") if line.isascii() and line.isprintable() else len("".join(line.split())))
        out: list[Judgement] = [(None, 0.0, [])] * len(texts)
        if not runs:
            return out
        ids = np.fromiter(map(self.vocabulary.__getitem__, runs), np.int64, len(runs))
        starts = np.cumsum([0, *sizes[:-1]])
        v = self.vocabulary
        score, known = (np.add.reduceat(t[ids], starts, axis=0) for t in (v.evidence, v.known))
        words = np.add.reduceat(v.parts[ids], starts)
        pure = v.letters[ids]
        countable_ = (np.add.reduceat((pure > 0).astype(np.int64), starts) >= least_words) & (np.add.reduceat(pure, starts) >= 0.6 * np.array(letters))
        owners = np.array(owners)
        first = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        total, total_known, total_words = (np.add.reduceat(x, first, axis=0) for x in (score, known, words))
        whole = _softmax(total)
        of_line = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(owners)]])))
        sure = score + CONTEXT_WEIGHT * (whole[of_line] - 1 / len(LANGUAGES))
        ends = np.append(starts[1:], len(runs))
        part = lambda a, b: [w for r in runs[a:b] for w in ([r] if r.isalpha() else _LETTERS.findall(r))]
        named, trust = self._named(sure, known, words, lambda i: part(starts[i], ends[i]))
        last = np.append(first[1:], len(starts)) - 1
        whole_named, whole_trust = self._named(total, total_known, total_words, lambda i: part(starts[first[i]], ends[last[i]]))
        segments: list[list[tuple[int, str, float]]] = [[] for _ in first]
        for i in np.flatnonzero(countable_).tolist():
            segments[of_line[i]].append((numbers[i], named[i], trust[i]))
        for i, d in enumerate(owners[first].tolist()):
            if total[i].any():
                out[d] = (whole_named[i], whole_trust[i], segments[i])
        return out

    def _named(self, score: np.ndarray, known: np.ndarray, words: np.ndarray, words_of: Callable[[int], list[str]]) -> tuple[list[str], list[float]]:
        """Languages of rows of scores and the confidence in them.

        Words of a line are no independent witnesses: for the confidence evidence grows with the root of their
        number. A row with too few words and trigrams known in its language is UNKNOWN, the surer the fewer are.
        """
        best = score.argmax(axis=1)
        n = np.maximum(words, 1)
        names = [LANGUAGES[b] for b in best.tolist()]
        trust = np.round(_softmax(score / np.sqrt(n)[:, None]).max(axis=1), 6).tolist()
        for i in np.flatnonzero(known[np.arange(len(best)), best] < LEAST_KNOWN * n).tolist():
            fit = self.model.fit(words_of(i), int(best[i]))
            if fit < LEAST_FIT:
                names[i], trust[i] = UNKNOWN, round(1 - fit / LEAST_FIT / 2, 6)
        return names, trust


def judge_document(model: LanguageModel, text: str | None, least_words: int = 4) -> Judgement:
    """Language and confidence of a text, and (line_no, language, confidence) of every countable line."""
    return Judge(model).documents([text], least_words)[0]


def detect(df: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """One row for each row of ``df``: id, label, lang, confidence, segments (line_no, lang, confidence).

    lang is null and confidence 0 for null and empty texts and for texts of which no word or n-gram is
    known; it is ``unknown`` where too few words are known in the language that fits best. The model is broadcast; its size is bounded by the parameters of :func:`train`. Ids may be null
    or repeated; other columns are not read.
    """
    kind = dict(df.dtypes)[id_column]
    broadcast = df.sparkSession.sparkContext.broadcast(model)
    segment = pa.struct([("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(broadcast.value)
        for batch in batches:
            found = judge.documents(batch.column(2).to_pylist())
            rows = [[{"line_no": n, "lang": lang, "confidence": c} for n, lang, c in lines] for _, _, lines in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(rows, pa.list_(segment))],
                names=["id", "label", "lang", "confidence", "segments"],
            )

    chosen = df.select(F.col(id_column).alias("id"), label_language(F.col(label_column)).alias("label"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, label string, lang string, confidence double, segments array<struct<line_no: int, lang: string, confidence: double>>")


def mislabelled_lines(detected: DataFrame) -> DataFrame:
    """(id, line_no, lang, confidence) of the lines whose language is not the label's; once each. Lines in no known language are left out."""
    lines = detected.select("id", "label", F.explode("segments").alias("s")).where(F.col("s.lang") != UNKNOWN)
    other = F.col("label").isNull() | (F.col("label") != F.col("s.lang"))
    return lines.where(other).select("id", "s.line_no", "s.lang", "s.confidence").dropDuplicates(["id", "line_no"])
