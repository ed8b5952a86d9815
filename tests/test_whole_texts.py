"""Queries that once took a part of each text, or of the rows, over texts longer than that part."""

import pytest

from docloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    rows = [(0, " ".join(f"w{i}" for i in range(450)), "en", "s", 1), (1, "π r 2", "en", "s", 1), (2, "$x$", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_every_word_is_in_a_row_of_some_page(spark, folder):
    rows = QUERIES["word_rows"](spark, folder).filter("doc_id = 0").collect()
    assert sorted(w for r in rows for w in r.text.split()) == sorted(f"w{i}" for i in range(450)) and {r.page for r in rows} == {0, 1, 2}


def test_forms_hold_all_pages(spark, folder):
    assert {r.page for r in QUERIES["form_segments"](spark, folder).filter("doc_id = 0").collect()} == {0, 1, 2}


def test_math_of_texts_without_dollars(spark, folder):
    got = {r.doc_id: r.latex for r in QUERIES["math_latex"](spark, folder).collect()}
    assert len(got) == 3 and "\\pi" in got[1] and got[2] == "$x$"
