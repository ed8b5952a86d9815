import random

import xxhash

from docloom.llm.components import components
from docloom.llm.simhash import fingerprint, keep_one, links, near_duplicates

BLANK = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words, word = [], ""
    for x in (text or "") + " ":
        if x in BLANK:
            words += [word] if word else []
            word = ""
        else:
            word += x.lower() if "A" <= x <= "Z" else x
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, bits=2):
    """points: node -> fingerprint; node -> least node reachable."""
    nodes = sorted(points)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (points[a] ^ points[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for text in ("", "  \n", "One", "one two", "a b c", "A B\tc d\x0be e e", "É é Ü", "x " * 70_000, " non breaking"):
        assert fingerprint(text) == plain_fingerprint(text)


def test_links_join_all_that_is_close(spark):
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:20]:  # chains and crowds around some of them
        for _ in range(40):
            g = f
            for _ in range(r.randrange(1, 4)):
                g ^= 1 << r.randrange(64)
            fps.add(g)
            f = g if r.random() < 0.3 else f
    fps |= {0, (1 << 64) - 1, 1, 1 << 63}
    points = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(signed(f), n) for n, f in points.items()], "fp long, node long")
    for bits in (0, 1, 2):
        for paired in (1, 6, 1000):
            found = links(df, bits, paired)
            got = {row.node: row.component for row in components(found).collect()}
            want = plain_components(points, bits)
            assert {n: got.get(n, n) for n in points} == want
            near = found.collect()
            assert all((points[x.a] ^ points[x.b]).bit_count() <= max(bits, 2) for x in near)


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from here " * 30
    rows = [(7, base), (3, base), (9, base + "once more"), (5, base.upper()), (11, "something else entirely"), (1, None), (2, ""), (4, "   "), (6, "something else"), (11, "something else entirely"), (None, base)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {}
    for d, t in rows:
        if d is not None:
            fps[d] = plain_fingerprint(t)
    want = plain_components(fps)
    assert len(out) == len(rows)
    for row in out:
        if row.doc_id is None:
            assert row.component_id is None
        else:
            assert (row.fingerprint, row.component_id) == (f"{fps[row.doc_id]:016x}", want[row.doc_id])


def test_rows_of_one_document_hold_together(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "one two three four five"), (5, "alpha beta gamma delta"), (5, "one two three four five")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {1}


def test_keep_one_and_empty(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from here " * 30
    df = spark.createDataFrame([(7, base, "a"), (3, base, "b"), (11, "other words here", "c"), (None, base, "d")], "doc_id long, text string, fp string")
    assert sorted((r.doc_id or 0, r.fp) for r in keep_one(df).collect()) == [(0, "d"), (3, "b"), (11, "c")]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(3, 3), (1, 900), (900, 901), (None, 4), (901, 1)]
    edges += [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in want:
                    want[x] = n
                    stack += near[x]
    assert got == want
