import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.frames import shared_folder
from docloom.operators import blocks as B
from docloom.operators import images as I
from docloom.operators import modules as G
from docloom.operators import packs as P
from docloom.operators import retrieval as R
from docloom.operators import words as W
from docloom.plans import assist, study
from docloom.sources.registry import read_files

STAMP = "2024-01-01T00:00:00.000Z"


def test_sudoku(spark):
    assert (G.clues_for(1, "easy"), G.clues_for(5, "medium"), G.clues_for(99, "hard"), G.clues_for(1, "odd")) == (40, 28, 22, 40)
    puzzle, full = G.sudoku(1, "easy")
    assert G.sudoku(1, "easy") == (puzzle, full) != G.sudoku(2, "easy") and puzzle.count("0") == 41
    assert all(sorted(full[i] for i in [*range(81)] if i // 9 == r) == list("123456789") for r in range(9))
    assert ["".join(map(str, s)) for s in G.solutions([int(x) for x in puzzle])] == [full]
    row = G.sudoku_puzzles(spark.createDataFrame([(1, "easy")], "level int, difficulty string")).first()
    assert (row.level, row.puzzle, row.clues) == (1, puzzle, 40)


def test_ball_sort(spark):
    tubes = G.ball_sort(3)
    assert len(tubes) == G.colours_for(3) + 2 and tubes == G.ball_sort(3) and sorted(x for t in tubes for x in t) == [c for c in range(5) for _ in range(4)]
    assert G.colours_for(1) == 4 and G.colours_for(99) == 12
    assert json.loads(G.ball_sort_puzzles(spark.createDataFrame([(3,)], "level int")).first().tubes) == tubes


def test_module_documents(spark):
    doc = G.custom_document("Game", {"html": "<p>x</p>"}, config={"a": 1})
    assert doc["version"] == 2 and doc["stats"]["gameCount"] == 1 and doc["games"][0]["config"] == {"a": 1}
    chess = G.chess_document("Chess", {"documentHtml": "<html></html>"}, fen="8/8", difficulty=1)
    assert chess["games"][0]["config"] == {"fen": "8/8", "playerColor": "w", "difficulty": 1, "mode": "play"}
    with pytest.raises(ValueError):
        G.custom_document("x", {})
    pack = G.pack_documents(spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, document string")).first().pack
    assert json.loads(P.unpack_bytes(bytes(pack))) == doc


def test_images():
    page = np.full((60, 80, 4), 255, dtype=np.uint8)
    page[20:30, 30:50, :3] = 90
    page[2, 2, :3] = 80  # a speck
    out = I.enhance(page)
    assert set(np.unique(out)) == {0, 255} and out.shape[0] < 60 and (out == 0).sum() >= 150
    assert I.enhance(page, photo=True).shape == (60, 80) and I.trim(np.full((5, 5), 255, np.uint8)).shape == (5, 5)
    assert 10 <= I.otsu(np.array([[10, 10, 200, 200]], dtype=np.uint8)) < 200
    assert I.stretch(np.full((3, 3), 7, np.uint8)).tolist() == [[7] * 3] * 3


def test_model_help(spark):
    class Model:
        def complete(self, prompts, temperature, max_tokens):
            return ["so \\ce{H2O}" if "water" in p else "none" for p in prompts]

    df = spark.createDataFrame([("Zn(s) + Cu2+(aq) -> Cu(s)",), ("water",), ("mystery",), ("the long prose about many metals and salts",), (None,)], "text string")
    got = {r.text: (r.normalized, r.assisted) for r in assist.chemistry_with_model(df, Model).collect()}
    assert got["Zn(s) + Cu2+(aq) -> Cu(s)"] == ("\\ce{Zn(s) + Cu^{2+}(aq) -> Cu(s)}", False) and got["water"] == ("\\ce{H2O}", True) and got["mystery"] == ("mystery", False)
    assert got["the long prose about many metals and salts"][1] is False and got[None] == (None, False)
    assert assist.math_with_model(spark.createDataFrame([("1/2",)], "text string")).first().normalized == "$\\frac{1}{2}$"
    assert assist.model_catalog(spark, [{"id": "a", "kind": "chat"}]).filter(assist.chat_capable(F.col("kind"))).count() == 1


def test_page_blocks(spark):
    words = [(1, 0, i, f"w{i}", 20.0 + 180 * (i % 3), 80.0 + 180 * (i % 3), 40.0 + 20 * (i // 3), 50.0 + 20 * (i // 3)) for i in range(12)]
    words = spark.createDataFrame(words, "doc_id long, page int, word_ix int, text string, x0 double, x1 double, top double, bottom double")
    lines = spark.createDataFrame([(1, 0, 0, "not used", 10.0, 0.0, 5.0, 9.0, 9.0), (1, 1, 0, "Head", 20.0, 0.0, 5.0, 9.0, 9.0), (1, 1, 1, "body", 10.0, 0.0, 30.0, 9.0, 9.0), (1, 1, 2, "body", 10.0, 0.0, 50.0, 9.0, 9.0)], "doc_id long, page int, line_no int, text string, font_size double, x double, y double, w double, h double")
    images = spark.createDataFrame([(1, 1, "data:x", (0.0, 20.0, 1.0, 1.0))], "doc_id long, page int, data_url string, bbox struct<x: double, y: double, w: double, h: double>")
    got = [(r.page, r.block_id, r.type) for r in W.page_blocks(words, lines, images).orderBy("page", "ord").collect()]
    assert got == [(0, "p0-b0", "table"), (1, "p1-b0", "heading"), (1, "p1-b1", "image"), (1, "p1-b2", "text"), (1, "p1-b3", "text")]


def test_files_to_packs_and_merges(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nOxidation is the loss of electrons by a species.")
    (tmp_path / "b.csv").write_text("h,i\nv,w")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1")
    files = read_files(spark, str(tmp_path))
    plain = {r.path.rsplit("/", 1)[1]: r for r in study.convert_and_pack(files, created_at=F.lit(STAMP)).collect()}
    assert json.loads(P.unpack_bytes(bytes(plain["b.csv"].pack)))["title"] == "b" and plain["c.pdf"].pack is None and plain["c.pdf"].error
    packs = study.files_to_study_packs(files, created_at=F.lit(STAMP)).filter("error is null").withColumnRenamed("path", "doc_id")
    named = packs.select("doc_id", F.lit(1).alias("merge_id"), F.when(F.col("doc_id").endswith("a.md"), 0).otherwise(1).alias("source_no"), F.regexp_extract("doc_id", "[^/]*$", 0).alias("label"))
    merged = json.loads(P.unpack_bytes(bytes(study.merge_packs(packs, named, F.lit(STAMP)).first().pack)))
    assert [b["id"] for b in merged["blocks"]] == ["m0_md-p0-b0", "m0_md-p0-b1", "m1_md-p0-b0"] and merged["markdown"].startswith("## Merged from: a.md\n\n# A") and merged["stats"]["flashCardCount"] == len(merged["flashCards"]) >= 1


def test_stored_blocks_and_strategies(spark, tmp_path):
    df = spark.createDataFrame([(1, "s1", "data:x"), (2, "s2", None)], "doc_id long, source string, data_url string")
    B.save_blocks(df, f"{tmp_path}/b")
    assert B.load_blocks(spark, f"{tmp_path}/b", "s2").first().doc_id == 2
    assert B.clear_blocks(spark, f"{tmp_path}/b", "s1") == 1 and [r.source for r in B.load_blocks(spark, f"{tmp_path}/b").collect()] == ["s2"]
    assert B.clear_blocks(spark, f"{tmp_path}/b", "s1") == 0 and B.clear_blocks(spark, f"{tmp_path}/b") == 1 and B.clear_blocks(spark, f"{tmp_path}/none") == 0
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, embedding array<float>")
    assert R.vector_search(vectors, asked, 1).first().chunk_id == R.vector_search(vectors, asked, 1, strategy="approximate").first().chunk_id == "a"
    with pytest.raises(ValueError):
        R.vector_search(vectors, asked, strategy="other")


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_a_pages_words_are_dealt_out_once(spark):
    from docloom.operators import words as W

    placed = spark.createDataFrame([(1, 0, i, "w", 10.0 * i, 10.0 * i + 8, 5.0, 9.0) for i in range(5)], "doc_id long, page int, word_ix int, text string, x0 double, x1 double, top double, bottom double")
    for made in (W.word_rows, W.form_segments):
        plan = made(placed)._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan and "hashpartitioning(doc_id" in plan


def test_boxes_and_their_copies(spark):
    """Copies of boxes, and boxes with missing sides, against every pair; copies are held against each other only once."""
    import random

    from docloom.operators import words as W

    r = random.Random(7)
    box = lambda: (float(r.randrange(4) * 5), float(r.randrange(3) * 5), r.choice([20.0, 20.0, 8.0]), r.choice([10.0, 10.0, None]))
    kind = "doc_id long, page int, {} long, bbox struct<x: double, y: double, w: double, h: double>"
    segments = [(i % 2, i % 3, i, box()) for i in range(120)]
    regions = [(i % 2, i % 3, i, box()) for i in range(90)] + [(1, 1, 900, None)]
    found = W.largest_overlap(spark.createDataFrame(segments, kind.format("segment_id")), spark.createDataFrame(regions, kind.format("region_id")))
    least = lambda *x: min(v for v in x if v is not None)
    most = lambda *x: max(v for v in x if v is not None)
    end = lambda b, at, size: None if b[size] is None or b[at] is None else b[at] + b[size]

    def share(a, b):
        b = b or (None,) * 4
        across = most(0.0, least(end(a, 0, 2), end(b, 0, 2)) - most(a[0], b[0]))
        low = [v for v in (end(a, 1, 3), end(b, 1, 3)) if v is not None]
        down = most(0.0, min(low) - most(a[1], b[1]) if low else None)
        return across * down / (most(b[2] * b[3], 1.0) if b[3] is not None else 1.0)

    want = {}
    for d, p, i, b in regions:
        fits = [(share(a, b), j) for d2, p2, j, a in segments if (d2, p2) == (d, p) and share(a, b) >= 0.2]
        if fits:
            want[d, p, i] = max(fits)[1]
    assert {(x.doc_id, x.page, x.region_id): x.segment_id for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3


def test_partitions_follow_the_files(spark, tmp_path, monkeypatch):
    from docloom.functions import frames

    cores = spark.sparkContext.defaultParallelism
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert frames.spread(df).rdd.getNumPartitions() == cores and frames.parts_of(df) == 4
    monkeypatch.setattr(frames, "EACH", 4000)
    assert frames.spread(df).rdd.getNumPartitions() > cores and frames.parts_of(df) > cores
    assert frames.parts_of(spark.createDataFrame([(1,)], "i int").rdd.toDF()) == 4
    assert len(frames.stored(df, "split", 1000).inputFiles()) >= 20
