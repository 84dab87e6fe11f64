"""Problem 6: garbled text from a wrong character encoding.

Two passes. The first counts in how many texts each character and each adjacent pair of characters occurs;
texts that look garbled by themselves are not counted, so that garble can't become probable by being
frequent. The second scores the pairs of every text by the mutual information of these counts, isolates runs
of improbable pairs as maximum-scoring segments, and tests inverse mappings in these runs and wherever
characters look like UTF-8 read with a wrong table. A mapping is accepted when it yields characters and
pairs that the corpus uses, or letters in the script of the word that they stand in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut, newest

#: Latin to Cyrillic and general punctuation to box drawing keep their own symbols, all else falls into 64 classes.
_LOW, _MID_FROM, _MID_TO, _CLASSES = 0x530, 0x2000, 0x2600, 64
SYMBOLS = _LOW + (_MID_TO - _MID_FROM) + _CLASSES
#: Share of all texts that is added to the expected number of texts with a pair: rare pairs count as improbable.
PRIOR_SHARE = 0.005
#: A pair speaks for a garbled run below this mutual information (bits); an ASCII pair speaks against with GAP.
THRESHOLD, GAP = -0.7, 0.35
#: A restored character must occur in so many texts of the corpus, unless the word around it has letters of its script.
LEAST_TEXTS = 3
#: Pairs rarer than this are all alike (bits of mutual information); they need not be counted apart.
LEAST_BITS = -8.0
#: Single-byte tables that UTF-8 is read with by mistake, and those that Cyrillic is mixed up between.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "cp1254", "iso8859-15", "iso8859-2")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
WESTERN = ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850")
OPENING, CLOSING = "“\"«„‘'‚`", "”\"»“’'`"
REPLACEMENT = "�"


def _symbol_table() -> np.ndarray:
    codes = np.arange(0x110000)
    table = _LOW + (_MID_TO - _MID_FROM) + (codes >> 8) % _CLASSES
    table[:_LOW] = codes[:_LOW]
    table[_MID_FROM:_MID_TO] = _LOW + np.arange(_MID_TO - _MID_FROM)
    ascii_ = codes[:128]
    table[:128] = np.where((ascii_ >= 97) & (ascii_ <= 122), 97, np.where((ascii_ >= 65) & (ascii_ <= 90), 65, np.where((ascii_ >= 48) & (ascii_ <= 57), 48, np.where(np.isin(ascii_, [9, 10, 13]), 32, ascii_))))
    return table.astype(np.int32)


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbol of each character: ASCII letters and digits are folded into classes."""
    return _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _document_frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (pairs as a * SYMBOLS + b; single symbols as -1 - a) and the number of texts with each."""
    joined = symbols("\n".join(texts)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(joined)]
    pair = joined[:-1] * SYMBOLS + joined[1:]
    keep = ((joined[:-1] >= 128) | (joined[1:] >= 128)) & (owner[1:] == owner[:-1])
    span = np.int64(SYMBOLS) * SYMBOLS
    pairs = np.unique(owner[1:][keep] * span + pair[keep]) % span
    single = np.unique(owner * np.int64(SYMBOLS) + joined) % SYMBOLS
    keys, n = np.unique(np.concatenate([pairs, -1 - single]), return_counts=True)
    return keys, n


def pair_frequencies(texts: DataFrame, column: str = "text") -> DataFrame:
    """(key, n) over the rows of ``texts`` that don't look garbled; the key -SYMBOLS - 1 has their number.

    Each partition gives one row for a key, so what is shuffled is bounded by the alphabet, not by the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            values = [t for t in batch.column(0).to_pylist() if t and not looks_garbled(t)]
            for at in range(0, len(values), 500):
                keys, n = _document_frequencies(values[at : at + 500])
                for k, v in zip(keys.tolist(), n.tolist()):
                    total[k] = total.get(k, 0) + v
            total[-SYMBOLS - 1] = total.get(-SYMBOLS - 1, 0) + len(values)
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    return texts.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _byte_map(codec: str) -> list[str]:
    """Character of each byte; bytes that a table leaves undefined are read as the control of that number."""
    return [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]


_CHARS = {codec: _byte_map(codec) for codec in {*READ_AS, *CYRILLIC, *WESTERN}}
_BYTES = {codec: {c: b for b, c in reversed(list(enumerate(chars)))} for codec, chars in _CHARS.items()}


def _sequence_pattern(codec: str) -> re.Pattern[str]:
    """Matches what the multi-byte sequences of UTF-8 look like when read with ``codec``."""

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c in _CHARS[codec][low:high]) + "]"

    tail = chars(0x80, 0xC0)
    return re.compile(f"(?:{chars(0xC2, 0xE0)}{tail}|{chars(0xE0, 0xF0)}{tail}{{2}}|{chars(0xF0, 0xF5)}{tail}{{3}})+")


_SEQUENCES = {codec: _sequence_pattern(codec) for codec in READ_AS}


def _through(text: str, wrong: str, right: str) -> str | None:
    """``text`` written with ``wrong`` and read with ``right``; None where that is impossible."""
    table = _BYTES[wrong]
    try:
        raw = bytes(table[c] for c in text)
        return raw.decode("utf-8") if right == "utf-8" else "".join(_CHARS[right][b] for b in raw)
    except (KeyError, UnicodeDecodeError):
        return None


#: Restored letters by script, and other characters that texts of any language have.
_LATIN, _GREEK, _CYRILLIC = "A-Za-zÀ-ÖØ-öø-ſȘ-ț", "Ά-ώ", "А-яЀЁЂ-Џѐё-џҐґ"
_SCRIPTS = [re.compile(f"[{x}]") for x in (_LATIN, _GREEK, _CYRILLIC)]
_COMMON_SIGNS = re.compile("[\xa0-¿×÷\u2010-\u2027\u202f-\u203a€№™−\U0001f300-\U0001faff]")
_CYRILLIC_LETTERS = re.compile("[Ѐ-ӿ]")


def _script(char: str) -> int | None:
    """Script of the first character: 0 Latin, 1 Greek, 2 Cyrillic."""
    return next((k for k, p in enumerate(_SCRIPTS) if p.match(char)), None)


def _sequence_masks() -> tuple[np.ndarray, np.ndarray]:
    """Bits of a character as the first and as the second of a sequence that restores to one of the above.

    A field of one bit for each table, once for two bytes, once for three (U+2000 to U+223F), once for four.
    """
    first, second = np.zeros(0x110000, np.uint64), np.zeros(0x110000, np.uint64)
    leads = ((*range(0xC2, 0xC6), 0xC8, 0xCE, 0xCF, 0xD0, 0xD1, 0xD2), (0xE2,), (0xF0,))
    tails = (range(0x80, 0xC0), range(0x80, 0x89), (0x9F,))
    for k, codec in enumerate(READ_AS):
        for kind in range(3):
            bit = np.uint64(1 << (kind * len(READ_AS) + k))
            for table, numbers in ((first, leads[kind]), (second, tails[kind])):
                for b in numbers:
                    table[ord(_CHARS[codec][b])] |= bit
    return first, second


_FIRST, _SECOND = _sequence_masks()


def _tables_of(text: str) -> list[str]:
    """Tables of READ_AS with which a sequence of UTF-8 may have been read somewhere in ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = int(np.bitwise_or.reduce(_FIRST[codes[:-1]] & _SECOND[codes[1:]], initial=np.uint64(0)))
    return [codec for k, codec in enumerate(READ_AS) if any(found >> (kind * len(READ_AS) + k) & 1 for kind in range(3))]


def _decoded(codec: str, part: str) -> str | None:
    """The part as UTF-8 that was read with ``codec``, up to three times over."""
    restored = _through(part, codec, "utf-8")
    for _ in range(2):
        again = _through(restored, codec, "utf-8") if restored and _SEQUENCES[codec].fullmatch(restored) else None
        if not again or any(_script(c) is None and not _COMMON_SIGNS.match(c) for c in again) or (codec == "mac_roman" and _script(again) == 2 and len(again) == 1):
            break  # a dash or an apostrophe before a letter is no sequence
        restored = again
    return restored


def _fits(restored: str, before: str, after: str) -> bool | None:
    """Whether restored characters can stand between their neighbours; None if nothing there says so.

    Letters must be of one script, also with letters that stand beside them.
    """
    scripts = [_script(c) for c in restored]
    letters = {x for x in scripts if x is not None}
    if len(letters) > 1 or any(x is None and not _COMMON_SIGNS.match(c) for x, c in zip(scripts, restored)):
        return False
    beside = [c for c, edge in ((before, scripts[0]), (after, scripts[-1])) if edge is not None and c.isalpha()]
    if any(_script(c) not in letters for c in beside):
        return False
    return bool(beside) or len(scripts) > 1 or None


def sequences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of what is UTF-8 read with a wrong table, whatever the corpus holds.

    Two characters that may be real text (a letter alone, a sign in a table where its first byte is a letter or
    a sign of real text) count only beside others of the same table. Quoted examples are left out.
    """
    by_table = []
    for codec in _tables_of(text):
        sure, alone = [], []
        for m in _SEQUENCES[codec].finditer(text):
            a, b = m.span()
            restored = None if _quoted(text, a, b) else _decoded(codec, m.group())
            fit = _fits(restored, text[a - 1 : a], text[b : b + 1]) if restored else False
            if fit is None:  # a letter or a sign alone
                sign = _COMMON_SIGNS.match(restored) and _CHARS[codec][0xC2] == "Â"
                certain = b - a > 2 or sign or (text[a] in "ÃĂ√" and text[a] == _CHARS[codec][0xC3] and text[b - 1] not in CLOSING)
            else:
                certain = codec not in CYRILLIC or len(restored or "") > 1 or b - a > 2 or _script(restored or " ") == 0
            if fit is not False:
                (sure if certain else alone).append((a, b, restored))
        if alone and not sure and codec in CYRILLIC and 0 < len(_CYRILLIC_LETTERS.findall(text)) == sum(len(_CYRILLIC_LETTERS.findall(text, a, b)) for a, b, _ in alone):
            sure, alone = alone, []  # no other Cyrillic letter in the text
        if sure:
            by_table.append((sum(b - a for a, b, _ in sure), sure, alone))
    by_table.sort(key=lambda x: -x[0])
    return _without_overlap([hit for k, (_, sure, alone) in enumerate(by_table) for hit in (sure + alone if k == 0 else sure)])


def _without_overlap(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Longer hits before shorter ones, then as given, each only where none before it lies; sorted by place."""
    if len(hits) < 2:
        return hits
    taken, out = bytearray(max(b for _, b, _ in hits)), []
    for a, b, restored in sorted(hits, key=lambda x: x[0] - x[1]):
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, restored))
    return sorted(out)


#: Words that a mix-up of single-byte tables gives: rows of marked Latin letters or signs, Cyrillic capitals in the middle of words.
_ODD_WORDS = re.compile(r"[À-ÖØ-öø-ſ]{4}|(?=[¿-ſƒ‚„‰‡†◊€⁄≈∆ﬁﬂ˘˙˚˛ˇ¬√«»“”‘’÷…–—]{6})[^À-ÿ]*[À-ÿ]+[^À-ÿ]{0,3}[À-ÿ]+|[░-▟╔-╬]{2}|[а-яё][А-ЯЁ]{2}|[ЃѓЂђЉЊЌЋЏљњќћџЈҐґЎў¤¦§¬][а-я]")


def looks_garbled(text: str) -> bool:
    """Whether a text should not be counted in the corpus that others are judged by."""
    return not text.isascii() and (bool(_ODD_WORDS.search(text)) or bool(sequences(text)))


@dataclass
class PairModel:
    """Mutual information of adjacent symbols, from document frequencies; sent to the workers in sparse form."""

    keys: np.ndarray
    counts: np.ndarray
    texts: int
    single: np.ndarray
    memo: dict[str, str | None] = field(default_factory=dict, repr=False)
    _dense: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def of(cls, rows: list[tuple[int, int]]) -> PairModel:
        keys, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        single = np.zeros(SYMBOLS, np.int64)
        one = (keys < 0) & (keys >= -SYMBOLS)
        single[-1 - keys[one]] = n[one]
        pairs = keys >= 0
        total = int(n[keys == -SYMBOLS - 1].sum())
        return cls(keys[pairs], n[pairs], max(total, 1), single)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}, "_dense": None}

    @property
    def dense(self) -> np.ndarray:
        """Bits of mutual information of every pair, with the prior added to what chance would give."""
        if self._dense is None:
            share = (self.single / self.texts).astype(np.float32)
            expected = np.outer(share, share) + np.float32(PRIOR_SHARE)
            seen = np.zeros((SYMBOLS, SYMBOLS), np.float32)
            seen.reshape(-1)[self.keys] = self.counts / self.texts
            self._dense = np.maximum(np.log2((seen + np.float32(0.25 / self.texts)) / expected), LEAST_BITS).astype(np.float16)
        return self._dense

    def mean_bits(self, text: str) -> float:
        """Mean mutual information of the pairs of ``text`` that are not of ASCII alone."""
        s = symbols(text)
        keep = (s[:-1] >= 128) | (s[1:] >= 128)
        return float(self.dense[s[:-1][keep], s[1:][keep]].mean(dtype=np.float32)) if keep.any() else 0.0

    def common(self, text: str) -> bool:
        """Whether the corpus has every non-ASCII character of ``text``."""
        s = symbols(text)
        s = s[s >= 128]
        return bool(len(s)) and bool((self.single[s] >= LEAST_TEXTS).all())


def maximal_segments(values: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (first, last) of a sequence, in linear time."""
    found: list[list[float]] = []  # first, last, sum before, sum at the end
    total = 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        segment = [i, i, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= segment[2]:
                j -= 1
            if j < 0 or found[j][3] >= segment[3]:
                break
            segment = [found[j][0], i, found[j][2], total]
            del found[j:]
        found.append(segment)
    return [(int(a), int(b)) for a, b, _, _ in found]


def improbable_runs(model: PairModel, text: str) -> list[tuple[int, int]]:
    """Spans of characters that the corpus makes improbable, as maximum-scoring segments of pair scores."""
    s = symbols(text)
    at = np.flatnonzero((s[:-1] >= 128) | (s[1:] >= 128))
    if not len(at):
        return []
    score = THRESHOLD - model.dense[s[at], s[at + 1]].astype(np.float32)
    above = np.flatnonzero(score > 0)
    if not len(above):
        return []
    # only the pairs above 0 are visited; what lies between two of them is one negative value
    running = np.cumsum(score, dtype=np.float64)
    between = np.diff(running[above]) - score[above[1:]] - GAP * (np.diff(at[above]) - np.diff(above))
    values = np.empty(2 * len(above) - 1)
    values[::2], values[1::2] = score[above], between
    place = at[above]
    return [(int(place[(a + 1) // 2]), int(place[b // 2]) + 2) for a, b in maximal_segments(values.tolist())]


def _quoted(text: str, start: int, end: int) -> bool:
    return 0 < start and end < len(text) and text[start - 1] in OPENING and text[end] in CLOSING


_ANY_SEQUENCE = re.compile("|".join(p.pattern for p in _SEQUENCES.values()))


def _utf8_again(model: PairModel, run: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of sequences that turn into common characters under one and the same table."""
    best: tuple[float, list[tuple[int, int, str]]] = (0.0, [])
    if not _ANY_SEQUENCE.search(run):
        return []
    for codec in READ_AS:
        hits, alone, gained = [], [], 0.0
        for m in _SEQUENCES[codec].finditer(run):
            restored = _decoded(codec, m.group())
            if restored is None or not model.common(restored):
                continue
            # a lone Cyrillic letter may be two characters of real Russian text, unless longer parts stand beside it
            lone = codec in CYRILLIC and len(restored) < 2 and "Ѐ" <= restored <= "ӿ"
            (alone if lone else hits).append((m.start(), m.end(), restored))
            gained += 0 if lone else len(m.group()) - 0.01 * len(restored)
        if any(len(r) > 1 and "Ѐ" <= r[0] <= "ӿ" for _, _, r in hits):
            hits = sorted(hits + alone)
        if gained > best[0]:
            best = (gained, hits)
    return best[1]


_PARTS = re.compile(r"[^\x00-\x7f]+(?:[\s|,.;:!?()\d·–-]+[^\x00-\x7f]+)*")


def _reread(model: PairModel, part: str) -> str | None:
    """The part with another single-byte table, if that explains it far better; remembered by part."""
    if part in model.memo:
        return model.memo[part]
    letters = sum(c.isalpha() and c > "\x7f" for c in part)
    before, best = model.mean_bits(part), None
    if letters >= 3 and before < 1.5:
        cyrillic = sum("Ѐ" <= c <= "ӿ" for c in part)
        for wrong in CYRILLIC if 2 * cyrillic > letters else WESTERN:
            for right in CYRILLIC:
                restored = _through(part, wrong, right) if wrong != right else None
                if restored is None or restored == part or sum("Ѐ" <= c <= "ӿ" for c in restored) < letters:
                    continue
                bits = model.mean_bits(restored)
                if bits > before + 1.0 and bits > 0.5 and (best is None or bits > best[0]):
                    best = (bits, restored)
    if len(model.memo) > 50_000:
        model.memo.clear()
    model.memo[part] = best and best[1]
    return model.memo[part]


def _other_table(model: PairModel, run: str) -> list[tuple[int, int, str]]:
    """Parts of the run that a mix-up of single-byte tables explains far better, with their restored text."""
    return [(m.start(), m.end(), restored) for m in _PARTS.finditer(run) if m.end() - m.start() > 2 and (restored := _reread(model, m.group()))]


_ADJACENT = re.compile(r"[^\x00-\x7f]{2}")
_CONTROLS = re.compile(r"[\x80-\x9f]")


def _controls(model: PairModel, text: str, changes: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], int]:
    """Control characters left over, as the characters that one table of Windows has in their place; how many have none."""
    inside = [range(a, b) for a, b, _ in changes]
    left = [m.start() for m in _CONTROLS.finditer(text) if not _quoted(text, m.start(), m.end()) and not any(m.start() in r for r in inside)]
    best: list[tuple[int, int, str]] = []
    for codec in ("cp1252", "cp1251", "cp1250"):
        found = [(i, i + 1, c) for i in left if model.common(c := _CHARS[codec][ord(text[i])])]
        if len(found) > len(best):
            best = found
    return best, len(left) - len(best)


def repair(model: PairModel, text: str | None) -> tuple[bool, str | None, int]:
    """Whether the text holds garbled parts, the text with them restored, and how many parts could not be.

    Parts that stand alone between quotation marks are examples that a text quotes and stay as they are.
    A replacement mark is a part that can't be restored. Null stays null.
    """
    if not text or text.isascii():
        return False, text, 0
    changes: list[tuple[int, int, str]] = []
    lost = sum(not _quoted(text, m.start(), m.end()) for m in re.finditer(REPLACEMENT + "+", text)) if REPLACEMENT in text else 0
    last = 0
    for start, end in improbable_runs(model, text):
        start, end = max(last, start - 3), min(len(text), end + 3)
        if end <= start or not _ADJACENT.search(text, start, end):  # every mapping needs two such characters
            continue
        while end < len(text) and text[end - 1] > "\x7f" and text[end] > "\x7f":
            end += 1
        while start > last and text[start] > "\x7f" and text[start - 1] > "\x7f":
            start -= 1
        run = text[start:end]
        again, other = _utf8_again(model, run), _other_table(model, run)
        hits = again if sum(b - a for a, b, _ in again) >= sum(b - a for a, b, _ in other) else other
        for a, b, restored in hits:
            if not _quoted(text, start + a, start + b):
                changes.append((start + a, start + b, restored))
                last = start + b
    changes = _without_overlap(changes + sequences(text))
    if _CONTROLS.search(text):
        more, lost_too = _controls(model, text, changes)
        changes, lost = sorted(changes + more), lost + lost_too
    out, at = [], 0
    for a, b, restored in changes:
        if a >= at:
            out += [text[at:a], restored]
            at = b
    return bool(changes) or lost > 0, "".join(out) + text[at:], lost


def fields_of(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The texts of all ``fields``, one row each."""
    return df.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("text")).where("text is not null")


def fit(df: DataFrame, fields: tuple[str, ...] = ("title", "text_content")) -> PairModel:
    """Mutual information of character pairs over all texts of ``fields``.

    Pairs whose share alone puts them at LEAST_BITS are left out before the counts come to the driver, as
    two columns of numbers; what is left is bounded by SYMBOLS squared whatever the number of texts.
    """
    counts = cut(pair_frequencies(fields_of(df, fields)))
    texts = counts.where(F.col("key") == -SYMBOLS - 1).agg(F.sum("n")).first()[0] or 0
    table = counts.where((F.col("key") < 0) | (F.col("n") + 0.25 > PRIOR_SHARE * 2.0**LEAST_BITS * texts)).toArrow()
    return PairModel.of(list(zip(*(table.column(c).to_pylist() for c in ("key", "n")))))


def restore(df: DataFrame, model: PairModel, fields: tuple[str, ...] = ("title", "text_content"), id_column: str = "id", order_column: str = "updated_at") -> DataFrame:
    """(id, field, restored, unrestorable) of each garbled field, of the newest row of each record.

    Nulls, empty and clean texts give no row. Null ids form one record; other columns are not read.
    """
    broadcast = df.sparkSession.sparkContext.broadcast(model)
    hit = pa.struct([("field", pa.string()), ("restored", pa.string()), ("unrestorable", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = broadcast.value
        for batch in batches:
            rows = [[] for _ in range(batch.num_rows)]
            for k, name in enumerate(fields):
                for i, text in enumerate(batch.column(2 + k).to_pylist()):
                    garbled, restored, lost = repair(pairs, text)
                    if garbled:
                        rows[i].append({"field": name, "restored": restored, "unrestorable": lost})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(hit))], names=["id", "order", "hits"])

    chosen = df.select(F.col(id_column).cast("string").alias("id"), F.col(order_column).cast("timestamp").alias("order"), *fields)
    judged = chosen.mapInArrow(run, "id string, order timestamp, hits array<struct<field: string, restored: string, unrestorable: int>>")
    return newest(judged, "id", "order", "hits").select("id", F.explode("hits").alias("h")).select("id", "h.field", "h.restored", "h.unrestorable")
