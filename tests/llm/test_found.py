"""The queries of the ten problems: SQL equivalents, shapes, and edge cases that all operators share."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quern.llm.oracles import ORACLES
from quern.llm.queries import QUERIES
from quern.schemas import schema

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
COLUMNS = {
    "p1_found": ["id", "line_no"], "p2_found": ["id", "boundary"], "p3_found": ["table_name", "id_a", "id_b"], "p4_found": ["owner_kind", "id_a", "id_b"], "p5_found": ["id", "line_no"],
    "p6_found": ["id", "field"], "p7_found": ["id", "field"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "line_no", "lang"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, data, rows_of, name):
    assert rows_of(QUERIES[name](spark, data).toPandas()) == rows_of(duck.execute(ORACLES[name]).fetch_df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_and_rows_are_distinct(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name.endswith("_found"):
        assert df.count() == df.distinct().count() > 0


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Tables of nulls, blanks and repeated rows, with columns that clash with names the operators use."""
    root = str(tmp_path_factory.mktemp("odd"))
    clash = {c: F.lit(7) for c in ("text", "order", "key", "tokens", "n", "tab", "lines", "hits", "site", "h", "s")}

    def write(table, rows, columns):
        whole = schema(table) if table != "documents" else None
        df = spark.createDataFrame(rows, columns)
        if whole:
            for f in whole.fields:
                if f.name not in df.columns:
                    df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        df.withColumns({k: v for k, v in clash.items() if k not in df.columns}).write.parquet(f"{root}/{table}.parquet")

    pages = [("1", "u1", None, None), ("2", "u2", "", ""), ("3", "u3", " \n\n ", " "), ("3", "u3", " \n\n ", " "), (None, None, "x y z", None), ("4", "u4", "word " * 3000, "t"), ("5", "u4", "é" * 9000, "t")]
    write("scrape_cache", pages, "id string, url string, text_content string, title string")
    write("urls", [("1", "u1", "A.example"), ("2", "u2", " "), ("3", "u3", None), ("3", None, "a.example")], "id string, url string, domain string")
    write("memory_facts", [("1", None), ("2", ""), ("3", "a b c d"), ("4", "a b c d"), (None, "a b c d")], "id string, text string")
    write("vectors", [("1", "memory", None, "emb-v1"), ("2", "memory", [0.0] * 128, "emb-v1"), ("3", "memory", [1.0] * 128, "emb-v1"), ("3", "memory", [1.0] * 128, "emb-v1"), ("4", "memory", [1.0] * 3, "emb-v1"), (None, "memory", [2.0] * 128, "emb-v1"), ("5", None, [2.0] * 128, "emb-v1")], "id string, owner_kind string, embedding array<float>, model string")
    spark.createDataFrame([(1, None, None, "a"), (2, "", "en", "a"), (3, "   ", "xx", None), (4, "ok then we go", "EN-gb", "b"), (4, "ok then we go", "EN-gb", "b"), (None, "日本 東京 大阪 京都", "", "a")], "doc_id bigint, text string, lang string, source string").withColumns({"id": F.lit(1), "label": F.lit(1), "segments": F.lit(2)}).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("none", 0.2, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{root}/mix_targets.parquet")
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd_tables, name):
    rows = QUERIES[name](spark, odd_tables).collect()
    if name == "p8_ids":
        assert {r.doc_id: list(r.ids) for r in rows}[1] == {r.doc_id: list(r.ids) for r in rows}[2] == [] and len(rows) == 6
    if name == "p2_found":
        assert {(r.id, r.boundary) for r in rows} == {("4", "word"), ("5", "none")}
    if name == "p3_found":
        assert {tuple(r) for r in rows} == {("memory_facts", "3", "4")}
    if name == "p4_nearest":
        assert rows == []
    if name == "p9_shares":
        assert {r.source: r.uses for r in rows}["none"] == 0
    if name == "p10_found":
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    root = str(tmp_path_factory.mktemp("empty"))
    for table in ("scrape_cache", "urls", "memory_facts", "vectors"):
        spark.createDataFrame([], schema(table)).write.parquet(f"{root}/{table}.parquet")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "source string, target_share double, max_repeats int").write.parquet(f"{root}/mix_targets.parquet")
    assert QUERIES[name](spark, root).count() == 0
