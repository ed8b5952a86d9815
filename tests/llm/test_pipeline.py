import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import language_id
from docloom.llm.common import tokenizer_path

from .test_decontaminate import plain_words
from .test_language_id import brute as plain_languages
from .test_line_dedup import brute as plain_lines  # noqa: F401
from .test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "der hund und die katze laufen mit dem ball über die wiese und sie sind auch nicht allein in dem garten mit {} "


def documents():
    common = "this line is a boilerplate line that stands in many documents of the corpus"
    rows = []
    for i in range(40):
        lang = "en" if i % 2 else "de"
        body = f"the dog and the cat number {i * i} run with a ball over the meadow {i} and they are not alone " * 3 if i % 2 else BASE.format(f"nummer{i * 17} und{i}") * 3
        rows.append((i, body + (f"\n{common}" if i % 3 == 0 else ""), lang, f"src{i % 4}", 0))
    near = "a text about nothing much that goes on and on about the same things in other words again and again " * 40
    rows += [(100, near, "en", "src0", 1), (101, near, "en", "src1", 1), (102, near + "extra", "en", "src0", 1), (103, "12345 67890 !!!", "en", "src0", 1), (104, None, None, None, None), (105, "", "de", "src1", 0)]
    rows += [(106, "clean start the secret question asks which river flows through the old town and why tail of it", "en", "src2", 5)]
    return [(d, t, l, s, n if n is None else len(t or "")) for d, t, l, s, n in rows]


ITEMS = [(1, "The secret question asks which river flows through the old town and why"), (2, None), (3, "never, ever")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def brute(spark, rows):
    frame = language_id.document_evidence(spark.createDataFrame(rows, SCHEMA))
    profiles = language_id.fit_profiles(frame)
    told = plain_languages(profiles, [(d, t, l, s) for d, t, l, s, _ in rows])
    rows = [r for r, x in zip(rows, told) if x[3]]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    held = {}
    for d, t, *_ in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(d)
    cut = []
    for d, t, *more in rows:
        cut.append((d, "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == d)))
    groups = plain_components({d: plain_fingerprint(t) for d, t in cut})
    cut = [(d, t) for d, t in cut if groups[d] == d]
    windows = [w[k : k + 10] for _, t in ITEMS if (w := plain_words(t)) for k in range(max(1, len(w) - 9))]
    leaks = lambda w: any(w[k : k + len(x)] == x for x in windows for k in range(len(w) - len(x) + 1))
    cut = [(d, t) for d, t in cut if not leaks(plain_words(t))]
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for d, t in cut:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        out += [(d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    return sorted(out)


def test_against_brute_force(spark, folder):
    got = P.run(spark, folder).collect()
    want = brute(spark, documents())
    assert sorted(tuple(r)[:5] for r in got) == want
    kept = {w[0] for w in want}
    assert 100 in kept and not kept & {101, 102, 103, 104, 105, 106} and len(kept) > 30
    assert len({r.sequence_id for r in got}) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes, name


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_line_stage_updates_lengths(spark):
    rows = [(i, f"own text {i}\n{'x' * 50}", "en", "s", 3) for i in range(6)]
    out = P.drop_common_lines(spark, spark.createDataFrame(rows, SCHEMA), "").orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in out[:2]] == [("own text 0", 10), ("own text 1", 10)] and (out[5].text, out[5].n_chars) == (rows[5][1], 3)
