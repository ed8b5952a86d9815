import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import language_id as L

WORDS = {"en": "the and of that with from which have this will".split(), "de": "der und die das nicht mit sich auch über für".split(), "fr": "les des une dans pour avec être que nous ça".split()}


def corpus(n=240, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        text = " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(3, 60)))
        said = lang if r.random() < 0.9 else r.choice(["en", "de", "fr", "xx", None, ""])
        rows.append((i, text, said, f"www.h{i % 7}.{'org' if i % 2 else lang}", lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, truth string")


def brute(profiles, rows):
    """The same posterior, counted and added up row by row."""
    names, k = profiles.languages, len(profiles.languages)
    kind = lambda d: d if d in names else "" if d in (None, "") else "?"
    scored = [(*profiles.score(t or ""), kind(d), h or "") for _, t, d, h, *_ in rows]
    best = [names.index(names[int(np.argmax(ll))]) if n else None for n, ll, _, _ in scored]
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1] if "." in h else ""
    by = {"host": defaultdict(Counter), "domain": defaultdict(Counter), "suffix": defaultdict(Counter), "said": defaultdict(Counter), "all": Counter()}
    for b, (_, _, said, host) in zip(best, scored):
        if b is not None:
            for key, value in (("host", host), ("domain", domain(host)), ("suffix", suffix(host)), ("said", said)):
                by[key][value][b] += 1
            by["all"][b] += 1
    total = sum(by["all"].values())
    everywhere = [(by["all"][i] + 1) / (total + k) for i in range(k)]
    kinds = [*names, "", "?"]
    out = []
    for (n, ll, said, host) in scored:
        if not n:
            out.append(("und", 0.0, None, False))
            continue
        scores = []
        for i in range(k):
            d, h, s = by["domain"][domain(host)], by["host"][host], by["suffix"][suffix(host)]
            p = (d[i] + L.DOMAIN_WEIGHT * everywhere[i]) / (sum(d.values()) + L.DOMAIN_WEIGHT)
            p = (h[i] + L.HOST_WEIGHT * p) / (sum(h.values()) + L.HOST_WEIGHT)
            # Hosts of texts without evidence have no row, so they have the prior of all and no suffix.
            prior = math.log(p) + math.log((s[i] + 1) / (by["all"][i] + len(by["suffix"]))) if sum(h.values()) else math.log(everywhere[i])
            told = (by["said"][said][i] + L.DECLARED_WEIGHT) / sum(by["said"][x][i] + L.DECLARED_WEIGHT for x in kinds)
            scores.append(ll[i] + prior + math.log(told))
        top = max(scores)
        posterior = 1 / sum(math.exp(x - top) for x in scores)
        out.append((names[scores.index(top)], round(posterior, 6), names[int(np.argmax(ll))], posterior >= 0.5))
    return out


def test_against_brute_force(spark):
    rows = corpus() + [(1000, None, "en", "www.h1.org", ""), (1001, "123 456 !!", None, None, ""), (1002, "", "de", "x", ""), (1003, "der und", None, None, ""), (1003, "der und", None, None, "")]
    df = frame(spark, rows)
    profiles = L.fit_profiles(df)
    got = sorted((r.doc_id, r.lang_id, round(r.posterior, 6), r.text_lang, r.accepted) for r in L.identify(df, profiles).collect())
    want = sorted((row[0], *x) for row, x in zip(rows, brute(profiles, rows)))
    for a, b in zip(got, want, strict=True):
        assert (a[0], a[1], a[3], a[4]) == (b[0], b[1], b[3], b[4]) and abs(a[2] - b[2]) < 1e-5


def test_held_out_accuracy(spark):
    profiles = L.fit_profiles(frame(spark, corpus(seed=3)))
    held = frame(spark, corpus(seed=77))
    rows = L.identify(held, profiles).collect()
    assert sum(r.lang_id == r.truth for r in rows) / len(rows) > 0.98
    assert all(r.accepted for r in rows)


def test_foreign_and_random_texts_are_rejected(spark):
    r = random.Random(8)
    foreign = [
        "Все люди рождаются свободными и равными в своём достоинстве и правах",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki",
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(9)) for _ in range(40)),
    ]
    rows = corpus() + [(1000 + i, x, said, "www.h1.org", "") for i, x in enumerate(foreign) for said in ("en", None)]
    df = frame(spark, rows)
    told = {(r.doc_id, r.declared): r for r in L.identify(df, L.fit_profiles(frame(spark, corpus(seed=4)))).collect()}
    assert all(r.accepted and r.lang_id == r.truth for (d, _), r in told.items() if d < 1000)
    assert {(r.lang_id, r.text_lang, r.accepted) for (d, _), r in told.items() if d >= 1000} == {("und", None, False)}


def test_evidence_beyond_the_text(spark):
    """A text that could be either is decided by its host, or by its declaration."""
    rows = [(i, "der und die das nicht mit sich", "de", "a.de", "") for i in range(60)] + [(100 + i, "the and of that with from which", "en", "b.com", "") for i in range(60)]
    odd = [(500, "on", None, "a.de", ""), (501, "on", None, "b.com", ""), (502, "on", "de", None, ""), (503, "on", "en", None, "")]
    df = frame(spark, rows + odd)
    got = {r.doc_id: r.lang_id for r in L.identify(df, L.fit_profiles(df)).collect()}
    assert [got[i] for i in (500, 501, 502, 503)] == ["de", "en", "de", "en"]


def test_empty_and_unlabelled(spark):
    empty = frame(spark, [])
    assert L.identify(empty, L.fit_profiles(empty)).collect() == []
    bare = frame(spark, [(1, "some words", None, None, "")])
    row = L.identify(bare, L.fit_profiles(bare)).first()
    assert (row.lang_id, row.accepted, row.truth) == ("und", False, "")


def test_three_hundred_languages(spark):
    """No language of the labelled rows is left out, however many there are."""
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03}": ["".join(r.choice(letters) for _ in range(6)) for _ in range(12)] for i in range(300)}
    rows = [(k * 300 + i, " ".join(r.choice(words[name]) for _ in range(40)), name, f"h{i}.org", name) for k in range(4) for i, name in enumerate(words)]
    df = frame(spark, rows)
    profiles = L.fit_profiles(df)
    assert profiles.languages == sorted(words)
    got = {x.doc_id: x for x in L.identify(df, profiles).collect()}
    assert all(got[d].lang_id == name and got[d].accepted for d, _, name, *_ in rows)


def test_clashing_columns_and_ties(spark):
    rows = [(1, "abc def", "aa", "h", "", 1), (2, "abc def", "bb", "h", "", 2), (3, "abc def", None, None, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, truth string, posterior int").withColumns({"__best": F.lit(9), "lang_id": F.lit("x")})
    out = {r.doc_id: r for r in L.identify(df, L.fit_profiles(df), 0.1).collect()}
    assert (out[1].lang_id, out[2].lang_id, out[1].text_lang, out[3].text_lang) == ("aa", "aa", "aa", "aa") and out[1].truth == ""
    lean = L.identify(df, L.fit_profiles(df), with_text=False)
    assert "text" not in lean.columns and lean.count() == 3


def test_trigrams_come_in_slices():
    text = "abc " * 600_000
    parts = list(L.trigrams(text))
    assert len(parts) > 1 and sum(map(len, parts)) == len(" " + " ".join(["abc"] * 600_000) + " ") - 2
    assert list(L.trigrams("")) == [] and list(L.trigrams("12")) == []


def test_pages(spark):
    html = '<!DOCTYPE html><HTML class="x" lang="DE-at"><head><script>the and of</script><style>p{}</style></head><body>der <!-- the --><b>und</b> die</body></html>'
    row = L.page_evidence(spark.createDataFrame([(1, "https://me@News.Example.DE:8080/x", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (row[0].declared, row[0].host, row[0].text.split()) == ("de", "news.example.de", ["der", "und", "die"])
    assert row[1].text is None and row[1].declared is None
