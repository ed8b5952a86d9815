"""Language ID: text likelihoods, declared markup language, address suffix and smoothed host priors in one posterior.

Texts are scored against byte-trigram profiles fitted on a bounded sample of rows with a declared language. How far
declarations, suffixes and hosts can be trusted is counted over all rows by grouped aggregation of what their texts say.
Every host gets a prior of its own, smoothed towards its domain's, and that towards the prior of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, texts
from .word_encoder import gathered

#: The profiles are fitted on about so many rows with a declared language, chosen by a hash.
SAMPLE_ROWS = 2000
#: Hashed trigrams of a profile.
BUCKETS = 1 << 16
#: A text's evidence counts as that of so many trigrams at most, as its trigrams aren't independent.
EFFECTIVE = 200
#: The unknown alternative: a trigram is twice as likely as if all buckets were equal, so that a profile of few texts, which is
#: nearly that even, loses too; and so probable is such a text beforehand.
UNKNOWN_LOG, UNKNOWN_PRIOR = -float(np.log(BUCKETS / 2)), 0.01
#: Pseudo-counts: towards the domain's prior, towards that of all, and of declarations and suffixes.
HOST_WEIGHT, DOMAIN_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 1.0
#: Bytes of a text that are scored at once.
SLICE = 1 << 20
#: A-Z lower-cased; other ASCII that isn't a letter parts words.
FOLD = bytes(x if 0x61 <= x <= 0x7A or x > 0x7F else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of a whole text's byte trigrams that hold a letter, in slices."""
    data = b" " + b" ".join(text.encode().translate(FOLD).split()) + b" "
    if len(data) < 3:
        return
    whole = np.frombuffer(data, dtype=np.uint8)
    for i in range(0, len(whole) - 2, SLICE):
        part = whole[i : i + SLICE + 2].astype(np.uint32)
        yield ((part[:-2] * 0x9E3B + part[1:-1] * 0x85EB + part[2:] * 0xC2B3) ^ (part[:-2] << 7) ^ (part[2:] << 11)) & (BUCKETS - 1)


class Profiles:
    """languages, and each one's log-likelihood of a trigram: floors where its profile lacks the bucket, and what is added where it has it.

    rows: the profiles' counts above 0 as arrays of language, bucket and count. Languages are as many as the labelled rows
    declare, and a profile takes room only for the buckets that it has.
    """

    def __init__(self, languages: list[str], language: np.ndarray, bucket: np.ndarray, count: np.ndarray):
        self.languages = languages
        order = np.argsort(bucket, kind="stable")
        self.language, bucket, count = language[order].astype(np.int32), bucket[order], count[order]
        self.sizes = np.bincount(bucket, minlength=BUCKETS)
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = np.bincount(self.language, weights=count, minlength=len(languages)) + 0.5 * BUCKETS
        self.floors, self.gains = np.log(0.5 / total), np.log((count + 0.5) / 0.5)

    def score(self, text: str) -> tuple[int, np.ndarray]:
        """The number of trigrams, and each language's log-likelihood, weighed down to EFFECTIVE trigrams."""
        n, total = 0, np.zeros(len(self.languages))
        for codes in trigrams(text):
            n += len(codes)
            known, times = np.unique(codes, return_counts=True)
            sizes = self.sizes[known]
            at = gathered(np.arange(len(self.language)), self.starts[known], sizes)
            total += len(codes) * self.floors + np.bincount(self.language[at], weights=self.gains[at] * np.repeat(times, sizes), minlength=len(total))
        return n, total * min(1.0, EFFECTIVE / n) if n else total

    def best(self, n: int, logs: np.ndarray) -> int | None:
        """The likeliest language; none for a text without trigrams, or one that the unknown alternative fits better."""
        return int(np.argmax(logs)) if n and logs.max() >= min(n, EFFECTIVE) * UNKNOWN_LOG + np.log(UNKNOWN_PRIOR) else None


def fit_profiles(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """From rows with text and declared; whole texts, of about sample_rows rows chosen by a hash of their text.

    Counts come by grouped aggregation, so the driver gets a number for each language and bucket of the sample and no texts.
    """
    labelled = rows.filter(F.col("declared").isNotNull() & (F.col("declared") != "")).select("declared", "text")
    share = min(1.0, sample_rows / max(1, labelled.count()))
    chosen = labelled.filter(F.pmod(F.xxhash64("text", "declared"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                for codes in trigrams(text):
                    found, times = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(times)], names=["declared", "bucket", "n"])

    counts = chosen.mapInArrow(count, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("declared").combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    place = np.array([languages.index(x) for x in names.dictionary.to_pylist()], dtype=np.int32)
    return Profiles(languages, place[names.indices.to_numpy()], counts.column("bucket").to_numpy(), counts.column("n").to_numpy())


def host_parts(host: Column) -> tuple[Column, Column]:
    """Domain (the last two labels) and suffix (the last label; empty for a host without a dot)."""
    labels = F.split(host, r"\.")
    many = F.size(labels) > 1
    return F.when(many, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host), F.when(many, F.element_at(labels, -1)).otherwise("")


def identify(rows: DataFrame, profiles: Profiles, min_posterior: float = 0.5, with_text: bool = True) -> DataFrame:
    """rows with lang_id, posterior, text_lang and accepted; without with_text, text is left out.

    rows: text, declared and host (any may be null); its other columns stay, but those named as the new ones. text_lang is
    the likeliest language by the text alone, lang_id by all evidence. A text without letters, null and empty ones among
    them, has no text_lang, gets lang_id "und" and isn't accepted; nor is one whose posterior is below min_posterior. The
    posterior has an unknown alternative, a text of evenly spread trigrams: a text that it fits better than any language
    has no text_lang and says nothing about its host, and where it wins by all evidence lang_id is "und". A null host is
    the host ""; a null declaration, or one of an unknown language, is evidence of its own kind. Ties go to the language
    that sorts first. Without profiles (an empty table) all is "und".

    Texts are scored once; the scored rows are written to the shared folder, with their texts only where these are wanted.
    """
    spark = rows.sparkSession
    small_batches(spark)
    new = ["lang_id", "posterior", "text_lang", "accepted", "__n", "__ll", "__best", "__host", "__said", "__prior", "__told", "__key", "__score"]
    base = rows.select(*(F.col(c) for c in rows.columns if c.lower() not in new))
    kept = [c for c in base.columns if with_text or c.lower() != "text"]
    names = profiles.languages
    if not names:
        return base.select(*kept, F.lit("und").alias("lang_id"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("accepted"))
    sent = spark.sparkContext.broadcast(profiles)  # bounded by the sample: 20 bytes for each bucket that a language has
    at = [c.lower() for c in base.columns].index("text")
    ours = [i for i, c in enumerate(base.columns) if c in kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.score(x) for x in texts(batch.column(at))]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([ll for _, ll in found], pa.list_(pa.float64())), pa.array([own.best(*x) for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in ours), *columns], names=[*kept, "__n", "__ll", "__best"])

    fields = ", ".join(f"`{base.schema[i].name}` {base.schema[i].dataType.simpleString()}" for i in ours)
    known = F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared").isNull() | (F.col("declared") == ""), "").otherwise("?")
    scored = saved(base.mapInArrow(score, f"{fields}, __n long, __ll array<double>, __best int").withColumns({"__host": F.coalesce("host", F.lit("")), "__said": known}), "scored")

    # What all texts say, by host and declaration, with partial sums before the exchange.
    cube = saved(scored.filter("__best is not null").groupBy(F.col("__host").alias("host"), F.col("__said").alias("said"), F.col("__best").alias("best")).agg(F.count("*").alias("n")), "evidence")
    size, kinds = len(names), [*names, "", "?"]
    overall, told = np.zeros(size), np.full((len(kinds), size), DECLARED_WEIGHT)
    for r in cube.groupBy("said", "best").agg(F.sum("n").alias("n")).collect():  # so many numbers as kinds times languages at most
        overall[r.best] += r.n
        told[kinds.index(r.said), r.best] += r.n
    everywhere = (overall + 1.0) / (overall.sum() + size)
    told = np.log(told / told.sum(axis=0, keepdims=True))

    domain, suffix = host_parts(F.col("host"))
    cells = cube.groupBy("host", "best").agg(F.sum("n").alias("n")).withColumns({"domain": domain, "suffix": suffix})

    def counts(key: str, name: str) -> DataFrame:
        """The counts of each key's languages as a map, which has no more entries than there are languages, and their sum."""
        summed = cells.groupBy(key, "best").agg(F.sum("n").alias("n"))
        return summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias(name), F.sum("n").alias(f"all_{name}"))

    hosts = counts("host", "c").withColumns({"domain": domain, "suffix": suffix})
    suffixes = saved(counts("suffix", "s"), "suffixes")
    kinds_of_suffix = suffixes.count()
    of = lambda c, i: F.coalesce(F.try_element_at(c, i), F.lit(0))
    shares, sums = F.lit(everywhere.tolist()), F.lit((overall + kinds_of_suffix).tolist())
    by_domain = lambda i: (of(F.col("d"), i) + DOMAIN_WEIGHT * F.get(shares, i)) / (F.col("all_d") + DOMAIN_WEIGHT)
    by_host = lambda i: (of(F.col("c"), i) + HOST_WEIGHT * by_domain(i)) / (F.col("all_c") + HOST_WEIGHT)
    by_suffix = lambda i: (of(F.col("s"), i) + 1.0) / F.get(sums, i)
    joined = hosts.join(counts("domain", "d"), "domain").join(suffixes, "suffix")
    # One row a host, written out: broadcast while it is small, and otherwise in a join that splits hot hosts.
    priors = saved(joined.select(F.col("host").alias("__key"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.log(by_host(i)) + F.log(by_suffix(i))).alias("__prior")), "priors")
    said = spark.createDataFrame([(k, row.tolist()) for k, row in zip(kinds, told)], "__said string, __told array<double>")

    placed = scored.join(priors, scored["__host"] == priors["__key"], "left").join(F.broadcast(said), "__said")
    unseen = F.lit(np.log(everywhere).tolist())
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    placed = placed.withColumn("__score", add(add(F.col("__ll"), F.coalesce("__prior", unseen)), F.col("__told")))
    top = F.array_max("__score")
    place = (F.array_position("__score", top) - 1).cast("int")
    # Hosts and declarations say as much about a text of the unknown alternative as about one of the likeliest language.
    unknown = F.least(F.col("__n").cast("double"), F.lit(float(EFFECTIVE))) * F.lit(UNKNOWN_LOG) + F.lit(float(np.log(UNKNOWN_PRIOR)))
    lead = unknown - F.get("__ll", place)
    some = F.col("__n") > 0
    posterior = F.lit(1.0) / (F.aggregate("__score", F.lit(0.0), lambda a, x: a + F.exp(x - top)) + F.exp(lead))
    languages = F.lit(names)
    return placed.select(*kept, F.when(some & (lead <= 0), F.get(languages, place)).otherwise("und").alias("lang_id"), F.when(some, posterior).otherwise(0.0).alias("posterior"), F.get(languages, F.col("__best")).alias("text_lang")).withColumn("accepted", (F.col("posterior") > 0) & (F.col("posterior") >= min_posterior))


def document_evidence(docs: DataFrame) -> DataFrame:
    """documents with declared and host: their language column and their source; columns of these names are replaced."""
    return docs.withColumns({"declared": F.col("lang").cast("string"), "host": F.col("source").cast("string"), "text": F.col("text").cast("string")})


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as text without markup, declared markup language and host."""
    html = F.col("html").cast("string")
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    lang = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    return pages.select("page_id", bare.alias("text"), F.nullif(lang, F.lit("")).alias("declared"), F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)).alias("host"))
