import random

from docloom.llm.decontaminate import find_leaks, spans_of, without_leaks, words_of


def plain_words(text):
    out, word = [], ""
    for x in (text or "") + " ":
        if x in "0123456789" or "a" <= x <= "z" or "A" <= x <= "Z" or ord(x) > 0x7F:
            word += x.lower() if "A" <= x <= "Z" else x
        elif word:
            out.append(word)
            word = ""
    return out


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = plain_words(t)
        hit, own = set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    own |= ids
        out.append((d, len(w), len(hit), len(own), ",".join(sorted(own))))
    return sorted(out, key=repr)


def ours(spark, docs, items, size, **more):
    d = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids)) for r in find_leaks(d, b, size, **more).collect()), key=repr)


def test_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["a", "b", "Ab", "x1", "é", "Éa", "中", "ab", "b2"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "-", "\n", "'", "_"]) for _ in range(n))
    items = [(i, text(r.randrange(2, 9))) for i in range(25)] + [(100, None), (101, "..."), (None, "a b c d"), (5, text(6)), (102, "b")]
    docs = [(i, text(r.randrange(0, 60))) for i in range(80)] + [(200, None), (201, ""), (0, "A b"), (202, "Capital Éa " * 5000), (None, items[0][1])]
    want = brute(docs, items, 4)
    assert ours(spark, docs, items, 4) == want
    assert ours(spark, docs, items, 4, block_bytes=400) == want  # several blocks, each a job


def test_blocks_share_items_texts_and_spans(spark):
    """Blocks of a few items each: a text hit by items of several blocks has all their words and spans, and copies stay rows."""
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(14))) for i in range(60)]
    docs = [(i % 30, f"Start, {items[i][1]}. {items[59 - i][1].upper()} end") for i in range(60)] + [(99, "nothing " * 30_000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, find_leaks(d, b, 10, block_bytes=n).collect())) for n in (1 << 20, 700))
    assert one == many and ours(spark, docs, items, 10, block_bytes=700) == brute(docs, items, 10)


def test_many_words(spark):
    """More words than one letter can number."""
    items = [(i, " ".join(f"word{i * 9 + k}" for k in range(9))) for i in range(3000)]
    docs = [(1, items[2999][1]), (2, items[0][1] + " " + items[2999][1]), (3, "word1 word2"), (4, "\x01\x02 Āᄀ 䀀")]
    assert ours(spark, docs, items, 10) == [(1, 9, 9, 1, "2999"), (2, 18, 18, 2, "0,2999"), (3, 2, 0, 0, ""), (4, 2, 0, 0, "")]


def test_words_inside_words_dont_count(spark):
    assert ours(spark, [(1, "xone two threex one two")], [(1, "one two three")], 10) == [(1, 5, 0, 0, "")]
    assert ours(spark, [(1, "x ONE-two, Three y")], [(1, "one two three")], 10) == [(1, 5, 3, 1, "1")]


def test_empty_tables(spark):
    assert ours(spark, [], [(1, "a")], 10) == []
    assert ours(spark, [(1, "a b")], [], 10) == [(1, 2, 0, 0, "")]


def test_spans_point_into_the_original(spark):
    text = "Éa, The Quick  brown FOX!"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = find_leaks(docs, spark.createDataFrame([(1, "the quick brown")], "item_id long, text string"), 3).first().leak_spans
    assert [text[s.start : s.end] for s in spans] == ["The Quick  brown"]
    assert len(words_of(text)) == 5 and spans_of(text, []) == []


def test_without_leaks(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e f", "y")], "doc_id long, text string, leak_spans string")
    kept = without_leaks(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
