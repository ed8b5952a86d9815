"""Each query with SQL against DuckDB, over the smallest tables; the others have to run."""

import importlib
import os
import sys

import pytest

from docloom.plans.queries import QUERIES, SQL

from .duck import same_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same_rows(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() > 0


@pytest.mark.parametrize("name", ["collapsed_lines", "guessed_formats", "text_files"])
def test_odd_texts(spark, name, tmp_path):
    """Empty and blank texts, a text that begins with numbers' lines, and one whose first 8 KiB alone are ASCII."""
    texts = ["", " ", "\n\n", ".5\n.6\nword", "a" * 9000 + "é end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "http://a.org", "<html></html>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_rows(QUERIES[name](spark, str(tmp_path)), SQL[name], tmp_path)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    """As if their folder and the pipeline weren't there."""
    for name in ("docloom.llm", "docloom.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    package = sys.modules["docloom"]
    if hasattr(package, "llm"):
        monkeypatch.delattr(package, "llm")
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    bare = importlib.import_module("__spark_entry__")
    try:
        assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(SQL)
    finally:
        sys.modules.pop("__spark_entry__", None)
