import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from docloom.llm.line_dedup import dedup_lines

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """rows: (doc_id, text); gives (doc_id, n_lines, n_dropped, sha256) per row."""
    key = lambda l: l.strip(BLANK).translate(LOW)
    held = defaultdict(set)
    for d, t in rows:
        for l in (t or "").split("\n"):
            if d is not None and len(key(l)) >= 40:
                held[key(l)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [l for l in lines if d is None or len(held.get(key(l), ())) < 5 or max(held[key(l)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_lines(df).collect()), key=repr)


def test_against_brute_force(spark):
    common = "This line stands in very many documents, É and all of it."
    rows = [(i, f"own {i}\n\t {common.upper() if i % 2 else common} \nshort\n\nshort{chr(10) + common if i == 3 else ''}") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, common), (3, rows[3][1]), (23, "x" * 100_000 + "\n" + common), (24, "four documents hold this other line, which is long enough")]
    rows += [(30 + i, "four documents hold this other line, which is long enough") for i in range(3)]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_rows_of_one_doc_id_keep_their_own_lines(spark):
    """Two texts under one doc_id: the common line stands at another place in each, or in one of them only."""
    common = "this line stands in more than five documents of the table"
    rows = [(i, common) for i in range(10, 16)] + [(1, f"a\nb\n{common}"), (1, "x\ny\nPRECIOUS and all its own line of over forty characters"), (1, f"{common}\nz"), (1, None), (1, f"a\nb\n{common}")]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_threshold_counts_code_points_of_the_key(spark):
    forty, thirty_nine = "é" * 40, "é" * 39
    rows = [(i, f"{forty}\n  {thirty_nine}  \n{forty}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df) == brute(rows)
    assert sorted(r.n_dropped for r in dedup_lines(df).collect()) == [0, 2, 2, 2, 2]


def test_empty_table_and_clashing_columns(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a", 7, "k", "x")], "doc_id long, text string, n_lines int, lost string, extra string").withColumns({"__row": F.lit(1), "__lines": F.lit(2)})
    row = dedup_lines(df).first()
    assert (row.n_lines, row.kept_text, row.extra) == (1, "a", "x")


def test_main_path_is_native(spark, capsys):
    dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string")).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))
