"""Problem 7: template residue, filler and error pages, by retrieval of labelled exemplars.

Labelled exemplars of residue, and of sentences that only speak of it, are held in an inverted index. Every
passage window (a sentence of a line) retrieves them; the containment of the window in its best exemplar,
weighted by tf-idf over the corpus, decides whether the window is residue. An unfilled placeholder is a token
that weighs as much as the passage it stands for. A text is residue when such windows cover enough of the
words that are not boilerplate by their block's number of words and that of its neighbours.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import boilerplate
from quern.runtime import newest

#: Labelled exemplars of residue; <slot> is an unfilled placeholder, <code> a number or id of four characters or more.
EXEMPLARS = (
    # missing pages
    "404", "404 not found", "page not found", "404 page not found", "the page you requested does not exist or was moved", "sorry, we can't find that page", "the page you were looking for doesn't exist",
    "check the address or go back to the start page", "this item is no longer available", "it may have been removed by the owner", "410 gone", "seite nicht gefunden", "die gesuchte seite gibt es nicht", "die gesuchte seite wurde nicht gefunden",
    "die angeforderte adresse gibt es nicht mehr", "diese adresse gibt es auf nicht mehr", "page introuvable", "l'adresse demandée n'existe pas sur", "cette page n'existe plus", "página no encontrada", "la dirección pedida ya no existe en", "esta página ya no existe",
    "страница не найдена", "запрошенного адреса больше нет на", "такой страницы нет", "такого адреса на сайте больше нет",
    # errors
    "500 internal server error", "internal server error", "error 500", "error 404", "error 403", "error 503", "fehler 404", "fehler 500", "erreur 404", "erreur 500", "error 502", "ошибка 404", "ошибка 500", "something went wrong on our side reference <code>", "an error has occurred, error code <code>", "502 bad gateway", "bad gateway proxy <code>", "proxy <code>", "503 service temporarily unavailable", "503 service unavailable",
    "504 gateway timeout", "error establishing a database connection", "fatal error uncaught typeerror cannot read value of null in file line <code>", "uncaught error in app <code> view line", "uncaught exception thrown in file on line", "stack trace render main",
    "traceback most recent call last", "file page line in render", "keyerror body", "exception in thread main java lang nullpointerexception", "warning undefined variable in on line",
    "interner serverfehler", "es ist ein fehler aufgetreten vorgang <code>", "vorgang <code>", "erreur interne du serveur", "une erreur est survenue référence <code>", "référence <code>", "error interno del servidor", "se ha producido un error referencia <code>", "referencia <code>", "внутренняя ошибка сервера", "произошла ошибка код <code>", "код <code>",
    # blocking
    "403 forbidden", "you don't have permission to access <code> on this server", "access denied", "your request was blocked contact the owner of", "please verify you are not a robot", "request <code>", "request id <code>",
    "checking your browser before accessing", "this takes up to seconds", "ray <code>", "ray id <code>", "zugriff verweigert", "accès refusé", "acceso denegado", "доступ запрещён", "too many requests", "unusual traffic from your network",
    "bitte bestätigen sie, dass sie kein roboter sind", "confirmez que vous n'êtes pas un robot", "confirme que no es un robot", "подтвердите, что вы не робот",
    # maintenance
    "the server is down for planned maintenance", "try again in minutes", "site under maintenance", "site maintenance", "we will be back in about minutes", "wegen wartung nicht erreichbar", "wir sind in etwa minuten wieder für sie da", "wartungsarbeiten", "bitte versuchen sie es in minuten erneut",
    "service momentanément indisponible", "site en maintenance", "merci de réessayer dans minutes", "sitio en mantenimiento", "vuelva a intentarlo en minutos", "технические работы", "повторите попытку через минут",
    # scripts
    "please turn on scripts in your browser to view", "this site requires javascript", "activate it and reload", "you need to enable javascript to run this app", "if nothing appears your browser blocks scripts", "please enable javascript to continue", "javascript seems to be disabled", "some features of will not work",
    "javascript scheint deaktiviert zu sein", "einige funktionen von sind nicht verfügbar", "bitte aktivieren sie javascript, um zu nutzen", "ihr browser blockiert skripte", "ohne sie wird nichts angezeigt",
    "javascript semble désactivé", "veuillez activer javascript pour afficher", "ce site a besoin de scripts et votre navigateur les bloque", "javascript parece desactivado", "active javascript para ver", "este sitio necesita scripts y su navegador los bloquea",
    "javascript отключён", "для работы сайта нужны скрипты, но они отключены", "включите javascript, чтобы открыть",
    # filler
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
    "lorem ipsum", "lorem ipsum dolor sit amet", "your text goes here", "your headline goes here", "add a caption", "describe the benefit in one sentence", "write a short description of your service", "this is sample text, replace it before you publish", "dummy content for layout tests", "insert title here", "title placeholder", "untitled document", "untitled", "new page", "coming soon", "sample page",
    "hier steht ein blindtext", "texte de remplissage à modifier", "texto de ejemplo que debe sustituirse", "здесь будет ваш текст", "текст-заполнитель", "loading", "just a moment", "one moment please",
    # placeholders
    "<slot>", "hello <slot>", "dear <slot>", "undefined", "null", "nan nan nan", "object object",
)

#: Labelled exemplars of sentences that speak of residue instead of being it.
COUNTER_EXEMPLARS = (
    "in the template language a value is written as and a loop as", "write the name in your template and the engine fills it in", "the placeholder is replaced by the value", "the shell variable and the marker are left as they are", "use this syntax to insert a variable", "the expression is evaluated by the template engine",
    "in der vorlage steht der platzhalter für den wert", "die variable wird durch den wert ersetzt", "dans le modèle la variable est remplacée par sa valeur", "en la plantilla la variable se sustituye por su valor", "в шаблоне переменная заменяется значением",
)

#: Fixed value: ways to write a field that a template engine should have filled.
PLACEHOLDER = re.compile(
    r"\{\{(?:[^{}\n]|\{[^{}\n]*\}|\}(?!\}))*\}\}|\$\{[^{}\n]+\}|\{%(?:[^%{\n]|%(?!\})|\{(?!%))*%\}|<%=?(?:[^%<\n]|%(?!>)|<(?!%))*%>|\[\[[\w .]+\]\]|@@[\w.]+@@|__[A-Z][A-Z0-9_]*__|%[A-Z][A-Z0-9_]+%|\[[A-Z][A-Z_]{2,}\]|\[insert [\w ]+\]|\b[A-Z]+_PLACEHOLDER\w*|\{[a-z][\w.]+\}",
    re.IGNORECASE,
)
_SHOUTED = re.compile(r"__[A-Z][A-Z0-9_]*__|%[A-Z][A-Z0-9_]+%|\[[A-Z][A-Z_]{2,}\]|\b[A-Z]+_PLACEHOLDER\w*|\{\{|\$\{|\{%|<%|\[\[|@@|\[[Ii]nsert |\{[a-z][\w.]+\}")
_MARK, _CODE = "\x01", "\x02"
_TOKEN = re.compile(r"[\x01\x02]|[^\W_]+")
_DIGIT = re.compile(r"\d")
_SENTENCE = re.compile(r"(?<=[.!?…;])\s+")
_SUFFIX = re.compile(r"\s[|–—-]\s[^|–—-]+$")
#: A window is residue from this containment on, a text from this coverage on, a title from this containment on.
LEAST_CONTAINMENT, LEAST_COVERAGE, LEAST_TITLE = 0.6, 0.3, 0.7
#: A placeholder weighs as much as this many unknown words. A window that a counter-exemplar contains to this part is none.
SLOT_WORDS, COUNTER_CONTAINMENT = 30, 0.4
#: A window must hold this part of an exemplar's weight, or so many of its words.
LEAST_OF_EXEMPLAR, ENOUGH_WORDS = 0.6, 4


def prepared(text: str) -> str:
    """Lower case, every placeholder as one mark, apostrophes as spaces."""
    if _SHOUTED.search(text):
        text = PLACEHOLDER.sub(lambda m: f" {_MARK} " if _SHOUTED.match(m.group()) else m.group(), text)
    return text.lower().replace("’", " ").replace("'", " ")


def words_of(window: str) -> list[str]:
    """Words of a prepared text; longer ones that hold digits are one token."""
    found = _TOKEN.findall(window)
    return [t if t.isalpha() or len(t) <= 3 or not _DIGIT.search(t) else _CODE for t in found] if _DIGIT.search(window) else found


def tokens(text: str) -> list[str]:
    return words_of(prepared(text))


def exemplar_tokens(exemplar: str) -> list[str]:
    return tokens(exemplar.replace("<slot>", _MARK).replace("<code>", _CODE))


def windows(text: str) -> Iterator[tuple[int, str]]:
    """Line number and text of the passage windows: the sentences of each line."""
    for number, line in enumerate(text.split("\n")):
        for sentence in _SENTENCE.split(line):
            if sentence.strip():
                yield number, sentence


VOCABULARY = frozenset(t for e in EXEMPLARS for t in exemplar_tokens(e))
COUNTER_VOCABULARY = frozenset(t for e in COUNTER_EXEMPLARS for t in exemplar_tokens(e))


def document_frequencies(texts: DataFrame, column: str) -> DataFrame:
    """(token, n): in how many texts each token of the exemplars occurs; '' has the number of texts.

    Windows that are residue when all tokens weigh the same are left out, so that residue doesn't lose weight
    by being frequent; texts of such windows alone are not counted. Every partition sends at most one row for each token of the exemplars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        even = ResidueIndex.of({})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found: set[str] = set()
                residue = other = False
                for _, window in windows(prepared(text)):
                    words = words_of(window)
                    inside = VOCABULARY.intersection(words)
                    if inside and even.words_are_residue(words):
                        residue = True
                    else:
                        found |= inside
                        other = other or bool(words)
                n.update(found)
                n[""] += other or not residue
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    return texts.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class ResidueIndex:
    """Inverted index of the exemplars with corpus weights; bounded by the exemplars."""

    weight: dict[str, float]
    other: float
    greatest: float
    postings: dict[str, list[int]] = field(default_factory=dict)
    whole: list[float] = field(default_factory=list)  # the weight of each exemplar, raised where all of it is asked for
    counter: list[frozenset[str]] = field(default_factory=list)
    bodies: boilerplate.BodyModel = field(default_factory=boilerplate.train)

    @classmethod
    def of(cls, frequencies: dict[str, int]) -> ResidueIndex:
        total = max(1, frequencies.get("", 1))
        weight = {t: math.log(1 + total / (1 + frequencies.get(t, 0))) for t in VOCABULARY if t != _MARK}
        other, greatest = sum(weight.values()) / len(weight), max(weight.values())
        weight[_MARK] = SLOT_WORDS * other
        postings: dict[str, list[int]] = defaultdict(list)
        whole = []
        for i, exemplar in enumerate(EXEMPLARS):
            distinct = set(exemplar_tokens(exemplar))
            whole.append(sum(weight[t] for t in distinct) * (1 if len(distinct) > 2 else (1 - 1e-9) / LEAST_OF_EXEMPLAR))
            for t in distinct:
                postings[t].append(i)
        return cls(weight, other, greatest, dict(postings), whole, [frozenset(exemplar_tokens(e)) for e in COUNTER_EXEMPLARS])

    def containment(self, words: list[str], least: float = 0.0) -> float:
        """Greatest tf-idf share of the window's words that one exemplar contains; 0 where it can't reach ``least``.

        An exemplar counts if the window holds LEAST_OF_EXEMPLAR of its weight (all of it for one or two words) or
        ENOUGH_WORDS of its words.
        """
        weight, other, total, known, inside = self.weight, self.other, 0.0, 0.0, []
        # what the known words weigh at most, against what the distinct unknown ones weigh at least
        marks = words.count(_MARK)
        strangers = len(set(words).difference(weight))
        most = (sum(map(weight.__contains__, words)) - marks) * self.greatest + marks * weight[_MARK]
        if most * (1 - least) < least * other * strangers:
            return 0.0
        for t, n in Counter(words).items():
            w = weight.get(t)
            if w is None:
                total += other * (1 + math.log(n)) if n > 1 else other
            else:
                w *= n if t == _MARK else 1 + math.log(n)  # every placeholder is a passage of its own
                total += w
                known += w
                inside.append((t, w))
        if not inside or known < least * total:  # no exemplar contains more than all of them together
            return 0.0
        score: dict[int, float] = defaultdict(float)
        held: dict[int, float] = defaultdict(float)
        shared: dict[int, int] = defaultdict(int)
        for t, w in inside:
            for e in self.postings.get(t, ()):
                score[e] += w
                held[e] += weight[t]
                shared[e] += 1
        return max((v for e, v in score.items() if shared[e] >= ENOUGH_WORDS or held[e] >= LEAST_OF_EXEMPLAR * self.whole[e]), default=0.0) / total

    def is_talk(self, words: list[str]) -> bool:
        """Whether a window with placeholders only speaks of them: a counter-exemplar holds enough of its other words."""
        distinct = set(words) - {_MARK, _CODE}
        return bool(distinct) and not COUNTER_VOCABULARY.isdisjoint(distinct) and max(len(distinct & c) for c in self.counter) >= max(2, COUNTER_CONTAINMENT * len(distinct))

    def words_are_residue(self, words: list[str], least: float = LEAST_CONTAINMENT) -> bool:
        """Whether a window of these words is residue."""
        return self.containment(words, least) >= least and not (_MARK in words and self.is_talk(words))

    def coverage(self, text: str) -> float:
        """Share of the words outside boilerplate that lie in residue windows."""
        covered, others = 0, []
        for line, window in windows(prepared(text)):
            words = words_of(window)
            if words and self.words_are_residue(words):
                covered += len(words)
            elif words:
                others.append((line, len(words)))
        if not covered:
            return 0.0
        boilerplate_lines = set(boilerplate.other_lines(self.bodies, text)) if others else set()
        return covered / (covered + sum(n for line, n in others if line not in boilerplate_lines))

    def text_is_residue(self, text: str | None) -> bool:
        return bool(text) and self.coverage(text) >= LEAST_COVERAGE

    def title_is_residue(self, title: str | None) -> bool:
        """As for a text of one window, with the name of the site or without it."""
        if not title or not title.strip():
            return False
        whole = prepared(title)
        return any(words and self.words_are_residue(words, LEAST_TITLE) for words in map(words_of, {whole, _SUFFIX.sub("", whole)}))


def fit(df: DataFrame, text_column: str = "text_content") -> ResidueIndex:
    """Weights of the exemplars' tokens from their frequencies over all texts."""
    return ResidueIndex.of({r.token: r.n for r in document_frequencies(df, text_column).collect()})


def detect(df: DataFrame, index: ResidueIndex, text_column: str = "text_content", title_column: str = "title", id_column: str = "id", order_column: str = "updated_at") -> DataFrame:
    """(id, field, coverage) of each field that is residue, of the newest row of each record.

    Null, empty and blank fields are no residue. A title has coverage 1. Null ids form one record; other
    columns are not read.
    """
    broadcast = df.sparkSession.sparkContext.broadcast(index)
    hit = pa.struct([("field", pa.string()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = broadcast.value
        for batch in batches:
            rows = []
            for title, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                hits = [{"field": title_column, "coverage": 1.0}] if judge.title_is_residue(title) else []
                if text and (share := judge.coverage(text)) >= LEAST_COVERAGE:
                    hits.append({"field": text_column, "coverage": share})
                rows.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(hit))], names=["id", "order", "hits"])

    chosen = df.select(F.col(id_column).cast("string").alias("id"), F.col(order_column).cast("timestamp").alias("order"), title_column, text_column)
    judged = chosen.mapInArrow(run, "id string, order timestamp, hits array<struct<field: string, coverage: double>>")
    return newest(judged, "id", "order", "hits").select("id", F.explode("hits").alias("h")).select("id", "h.field", "h.coverage")
