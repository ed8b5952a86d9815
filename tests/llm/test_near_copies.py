import random
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from docloom.llm.near_copies import crowded_links, marks, near_copies

from .test_simhash import plain_fingerprint


def jaccard(a: str, b: str) -> float:
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def texts(seed=5):
    """Originals, and copies with 1 to 12 of their words replaced."""
    r, out = random.Random(seed), []
    for k in range(40):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 300))]
        out.append(" ".join(words))
        for _ in range(4):
            changed = list(words)
            for _ in range(r.randrange(1, 13)):
                changed[r.randrange(len(words))] = f"x{r.randrange(4000)}"
            out.append(" ".join(changed))
    return out


def grouped(held):
    up = list(range(len(held)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(held)):
        for j in range(i // 5 * 5, i):
            if jaccard(held[i], held[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(held))]


def test_all_pairs_of_the_similarity_link(spark):
    held = texts()
    want = grouped(held)
    got = dict(near_copies(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")).collect())
    assert [got[i] for i in range(len(held))] == want
    assert 40 < len(set(want)) < len(held)


def test_stage_drops_a_near_copy_that_differs_in_many_bits(spark):
    held = texts()
    far = next((a, b) for i, a in enumerate(held) for b in held[i + 1 : i // 5 * 5 + 5] if jaccard(a, b) >= 0.8 and (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() > 4)
    rows = [(1, far[0], "en", "s", 1), (2, far[1], "en", "s", 1), (3, "quite another text of a few words", "en", "s", 1)]
    kept = P.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_crowded_bands_copies_and_rows_without_id(spark):
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], "other", *base[i + 1 :]])) for i in range(5, 105)]
    rows += [(200, " ".join(base).upper()), (201, "  ".join(base)), (None, " ".join(base)), (300, None), (301, ""), (302, "a b"), (303, "a c"), (400, "a b"), (400, "z z z")]
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id is not None and r.doc_id < 300} == {5}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is None or r.doc_id >= 300} == {(None, None), (300, 300), (301, 300), (302, 302), (303, 303), (400, 302)}


def test_second_pass_over_a_crowded_band(spark):
    """Every link between different components that a crowded band holds, however the nodes fall into blocks."""
    r = random.Random(3)
    base = [f"word{i}" for i in range(150)]
    held = []
    for _ in range(50):
        own = list(base)
        for i in r.sample(range(150), r.randrange(1, 9)):
            own[i] = f"other{r.randrange(9999)}"
        held.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    points = marks(docs, 5).select(F.col("doc_id").alias("node"), "bands", "sign")
    bands = {x.node: list(x.bands) for x in points.collect()}
    crowded = Counter((k, v) for own in bands.values() for k, v in enumerate(own))
    part = {i: 0 for i in range(20)} | {i: 40 for i in (40, 41, 42)}
    want = set()
    for i in range(50):
        for j in range(i + 1, 50):
            common = [(k, v) for k, (v, w) in enumerate(zip(bands[i], bands[j])) if v == w]
            if part.get(i, i) != part.get(j, j) and common and crowded[common[0]] > 12 and jaccard(held[i], held[j]) >= 0.8:
                want.add((i, j))
    component = spark.createDataFrame(list(part.items()), "node long, component long")
    for block in (4, 1000):
        got = [tuple(x) for x in crowded_links(docs, points, component, 5, 0.8, 12, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_stage_links_by_simhash_and_by_similarity(spark):
    """1, 2 and 5 are near copies by SimHash only (most of their shingles are repeats), 2 and 3 by Jaccard only; 4 has the words of 2."""
    r = random.Random(11)
    line = "the same line stands in this text again and again and fills all of it "  # an odd number of shingles: no bit is set in half of them
    tail = lambda n: " ".join(f"t{r.randrange(10**6)}" for _ in range(n))
    bits = lambda a, b: (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count()
    one, two, five = (line * 400 + tail(60) for _ in range(3))
    words = sorted(set(two.split()) - set(line.split()))
    three = line * 3 + two[len(line) * 400 :]
    assert len(words) > 50 and jaccard(one, two) < 0.5 and jaccard(two, three) >= 0.8 and bits(one, two) <= 2 and bits(one, five) <= 2 < min(bits(two, three), bits(one, three))
    held = {1: one, 2: two, 3: three, 4: two.upper(), 5: five, 6: tail(80), 7: tail(80)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in held.items()] + [(None, one, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id for r in kept), key=lambda x: (x is None, x)) == [1, 6, 7, None]
