"""What the engine asks of models, and stand-ins that need none."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Texts to vectors; queries and documents may be told apart by a prefix."""

    model: str
    dim: int

    def embed(self, texts: list[str], as_query: bool = False) -> list[list[float]]: ...


class ChatModel(Protocol):
    """A prompt to an answer."""

    def chat(self, system: str, user: str) -> str: ...


class StubEmbedder:
    """Deterministic vectors from the characters of a text, for tests and offline runs."""

    def __init__(self, dim: int = 8, model: str = "stub-embedder", query_prefix: str = "", document_prefix: str = ""):
        self.dim, self.model, self.prefix = dim, model, {True: query_prefix, False: document_prefix}

    def embed(self, texts: list[str], as_query: bool = False) -> list[list[float]]:
        out = []
        for text in texts:
            v, at = np.zeros(self.dim), 0
            for c in self.prefix[as_query] + text:
                v[at % self.dim] += (ord(c) % 17 + 1) / 16
                at += len(c.encode())
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else np.eye(self.dim)[0]).tolist())
        return out


class ExtractiveChat:
    """Answers with the facts of the prompt, or INSUFFICIENT where none shares a word with the question."""

    def chat(self, system: str, user: str) -> str:
        facts, _, question = user.partition("\n\n")
        words = set(re.findall(r"\w{4,}", question.lower()))
        kept = [f for f in facts.split("\n") if words & set(re.findall(r"\w{4,}", f.lower()))]
        return "\n".join(kept) or "INSUFFICIENT"


def embedded(rows: DataFrame, embedder: Embedder, owner_kind: str, text_column: str = "text") -> DataFrame:
    """(id, owner_kind, embedding, model, dim) of rows with a text that is not blank; models run on the workers."""
    model, dim = embedder.model, embedder.dim

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"].to_numpy(object), "embedding": embedder.embed(part["text"].tolist())})

    chosen = rows.select(F.col("id").cast("string").alias("id"), F.col(text_column).alias("text")).where("trim(text) <> ''")
    vectors = chosen.mapInPandas(run, "id string, embedding array<float>")
    return vectors.select("id", F.lit(owner_kind).alias("owner_kind"), "embedding", F.lit(model).alias("model"), F.lit(dim).alias("dim"))
