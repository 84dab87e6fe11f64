"""The queries of the ten problems, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import boilerplate, encoding, language, mixing, neighbours, repeated, residue, signatures, splitting, tokens
from quern.runtime import cut, read_table


def _pages(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return read_table(spark, root, "scrape_cache", columns)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of text_content that are not main body."""
    pages = _pages(spark, root, "id", "updated_at", "raw_html", "clean_html", "text_content")
    found = boilerplate.extract(pages, residue.fit(pages))
    return found.select("id", F.explode("other_lines").alias("line_no"))


def p1_main(spark: SparkSession, root: str) -> DataFrame:
    """Main body of each page."""
    pages = _pages(spark, root, "id", "updated_at", "raw_html", "clean_html", "text_content")
    return boilerplate.extract(pages, residue.fit(pages), with_text=True).select("id", "main")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Oversized texts and the boundary at which they are cut."""
    return splitting.split_oversized(_pages(spark, root, "id", "updated_at", "text_content")).where("piece_no = 0").select("id", "boundary")


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of oversized texts."""
    return splitting.split_oversized(_pages(spark, root, "id", "updated_at", "text_content"))


PAGE_COPIES = signatures.Collection("scrape_cache", words=3, threshold=0.6, least=50)
FACT_COPIES = signatures.Collection("memory_facts", words=1, threshold=0.7)


def _copies(spark: SparkSession, root: str) -> list[tuple[signatures.Collection, DataFrame]]:
    pages = _pages(spark, root, "id", "text_content", "updated_at").toDF("id", "text", "order")
    facts = read_table(spark, root, "memory_facts", ["id", "text", "updated_at"]).toDF("id", "text", "order")
    return [(PAGE_COPIES, pages), (FACT_COPIES, facts)]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of near-duplicate pages and facts."""
    return signatures.similar_pairs(_copies(spark, root)).select("table_name", "id_a", "id_b")


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    """Group and number of links of every page and fact that has a near-duplicate."""
    return signatures.similar_groups(_copies(spark, root))


def _nearest(spark: SparkSession, root: str) -> DataFrame:
    vectors = read_table(spark, root, "vectors", ["id", "owner_kind", "embedding", "model", "created_at"])
    return neighbours.nearest(neighbours.usable(vectors))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of vectors of which one is among the 5 most similar of the other."""
    return neighbours.neighbour_pairs(_nearest(spark, root))


def p4_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The 5 most similar vectors of every vector, with their similarity."""
    return _nearest(spark, root)


def _repeated(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    pages = _pages(spark, root, "id", "url", "text_content", "updated_at")
    return pages, repeated.repeated_lines(pages, read_table(spark, root, "urls", ["url", "domain"]))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines repeated within their site."""
    return _repeated(spark, root)[1].select("id", "line_no")


def p5_clean(spark: SparkSession, root: str) -> DataFrame:
    """Texts without the lines repeated within their site."""
    return repeated.without_lines(*_repeated(spark, root))


def _garbled(spark: SparkSession, root: str) -> DataFrame:
    pages = _pages(spark, root, "id", "title", "text_content", "updated_at")
    return encoding.restore(pages, encoding.fit(pages))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Fields with text from a wrong encoding."""
    return _garbled(spark, root).select("id", "field")


def p6_restored(spark: SparkSession, root: str) -> DataFrame:
    """These fields with their text restored as far as possible."""
    return _garbled(spark, root)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Fields that are template residue, filler or error messages."""
    pages = _pages(spark, root, "id", "title", "text_content", "updated_at")
    return residue.detect(pages, residue.fit(pages)).select("id", "field")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(read_table(spark, root, "documents", ["doc_id", "text"]), "doc_id", "text")


def _sized(spark: SparkSession, root: str) -> DataFrame:
    documents = read_table(spark, root, "documents", ["doc_id", "text", "source"])
    return cut(tokens.count_tokens(documents, "doc_id", "text", carried=("source",)))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """The training sequence: which document comes at which position, as which copy."""
    return mixing.mix(_sized(spark, root), read_table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached shares of the sources."""
    sized, targets = _sized(spark, root), read_table(spark, root, "mix_targets")
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


def _languages(spark: SparkSession, root: str) -> DataFrame:
    documents = read_table(spark, root, "documents", ["doc_id", "text", "lang"])
    return language.detect(documents, language.train(documents))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines whose language is not that of their document's label."""
    return language.mislabelled_lines(_languages(spark, root)).select(F.col("id").alias("doc_id"), "line_no", "lang")


def p10_languages(spark: SparkSession, root: str) -> DataFrame:
    """Language and confidence of every document."""
    return _languages(spark, root).select(F.col("id").alias("doc_id"), "label", "lang", "confidence", F.filter("segments", lambda s: s["lang"] != F.col("lang")).alias("other_segments"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_main, p2_found, p2_pieces, p3_found, p3_groups, p4_found, p4_nearest, p5_found, p5_clean, p6_found, p6_restored, p7_found, p8_ids, p9_mix, p9_shares, p10_found, p10_languages)
}
