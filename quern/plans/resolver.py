"""Answering a batch of questions: from memory, from the query cache, else by a live search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions.text import normalize_query
from quern.functions.tiers import fresh
from quern.operators import vectors
from quern.runtime import cut
from quern.sources.models import ChatModel, Embedder, embedded

#: Fixed value: what a model answers when the facts don't do.
INSUFFICIENT = "INSUFFICIENT"


def plan(questions: DataFrame, facts: DataFrame, cache: DataFrame, known: DataFrame, embedder: Embedder | None, now: datetime, settings: Settings = Settings()) -> DataFrame:
    """(id, source, cache_id, facts): how each question (id, term) is answered.

    The order is memory, exact cache, semantic cache, live. Without an embedder or without vectors the
    semantic steps are skipped. Facts come joined, nearest first.
    """
    asked = questions.select("id", "term", normalize_query(F.col("term")).alias("query_norm"))
    exact = cache.where(fresh(F.lit(now), F.col("expires_at"), F.col("fetched_at"))).groupBy("query_norm").agg(F.min("id").alias("exact_id"))
    out = asked.join(exact, "query_norm", "left")
    if embedder is None:
        empty = out.select("id", F.lit(None).cast("string").alias("near_id"), F.lit(None).cast("string").alias("facts"))
    else:
        memory = settings.memory
        found = cut(vectors.search(known, embedded(questions, embedder, "search", "term"), memory.top_k))
        near = vectors.cached_answers(found, cache, memory.similarity_threshold, now).select(F.col("query_id").alias("id"), F.col("id").alias("near_id"))
        gated = vectors.gated_facts(found, facts, memory.similarity_threshold, now).join(facts.select("id", "text"), "id")
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id", "text")))  # top_k facts
        joined = gated.groupBy(F.col("query_id").alias("q")).agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("facts"))
        empty = asked.select("id").join(near, "id", "left").join(joined, F.col("id") == F.col("q"), "left").select("id", "near_id", "facts")
    resolved = out.join(empty, "id")
    source = F.when(F.col("facts").isNotNull(), "memory").when(F.col("exact_id").isNotNull() | F.col("near_id").isNotNull(), "cache").otherwise("live")
    return resolved.select("id", source.alias("source"), F.coalesce("exact_id", "near_id").alias("cache_id"), "facts")


def adjudicated(planned: DataFrame, questions: DataFrame, chat: ChatModel) -> DataFrame:
    """(id, source, answer): memory answers that the model finds insufficient fall back to the cache or to live."""
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [chat.chat("Answer from the facts or say INSUFFICIENT.", f"{facts}\n\n{term}") if facts else None for facts, term in zip(part["facts"], part["term"])]
            fallback = part["cache_id"].notna().map({True: "cache", False: "live"})
            fails = [a is not None and a.startswith(INSUFFICIENT) for a in answers]
            yield pd.DataFrame({"id": part["id"].astype(object), "source": [f if bad else s for s, f, bad in zip(part["source"], fallback, fails)], "answer": pd.Series([None if bad else a for a, bad in zip(answers, fails)], dtype=object)})

    return planned.join(questions.select("id", "term"), "id").mapInPandas(run, "id string, source string, answer string")


def combined(sources: DataFrame, group: str) -> DataFrame:
    """(group, source) of requests with several terms: the one source, mixed for several, live for none."""
    kinds = sources.groupBy(group).agg(F.count_distinct("source").alias("n"), F.min("source").alias("one"))
    return kinds.select(group, F.when(F.col("n") == 0, "live").when(F.col("n") == 1, F.col("one")).otherwise("mixed").alias("source"))


def distil_prompt(text: str, detail: str = "brief", limit: int = 8000) -> tuple[str, str]:
    """System and user message that ask for the facts of a page as JSON; the text is cut on a code point."""
    amount = {"brief": "the 5 to 15 most important facts", "full": "every fact"}.get(detail, "the most important facts")
    system = f'Extract {amount} from the page as a JSON array of {{"text": ..., "volatility": "stable" or "time-sensitive"}}. Answer with the array alone.'
    return system, text.encode()[:limit].decode(errors="ignore")
