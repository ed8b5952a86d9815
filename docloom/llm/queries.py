"""The corpus operators as queries over whole tables, with production parameters; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, licenses, line_dedup, media, packing, secret_scan, simhash, token_counts, token_files
from .common import shared_path, table

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_id.document_evidence(table(spark, sf_dir, "documents"))
    found = language_id.identify(rows, language_id.fit_profiles(rows), with_text=False)
    return found.select("doc_id", "lang_id", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_id.page_evidence(table(spark, sf_dir, "pages"))
    found = language_id.identify(rows, language_id.fit_profiles(rows), with_text=False)
    return found.select("page_id", "lang_id", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "host", "accepted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "sentence_ids", "n_sentences", "licenses")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.train(secret_scan.own_findings(spark))
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), forest, F.col("source"))
    return found.select("doc_id", "line_no", "ordinal", F.sha2("candidate", 256).alias("candidate_sha256"), F.char_length("candidate").alias("n_chars"), "probability", "is_secret")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTES, 1024)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), 40, 5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_leaks(docs, items, 10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORDS, 1, 4096)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"), WORDS, 1)
    return token_files.read_token_files(spark, path)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page that shows its payload: padded texts go to the store, pages refer to them by digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.octet_length(text)
    gap = F.when(n == 0, media.WIDTH).otherwise(F.pmod(-n, F.lit(media.WIDTH)))
    payload = F.concat(text, F.repeat(F.lit(" "), gap))
    docs = table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("__payload"))
    path = media.write_media(docs.select(F.encode("__payload", "utf-8").alias("payload")), shared_path(spark, "media"))
    page = F.concat(F.lit("<figure><img src='" + media.SCHEME), F.sha2("__payload", 256), F.lit("'><figcaption>"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    shown = media.resolve(media.interleave(docs.select("doc_id", "n_bytes", page.alias("html"))), media.read_media(spark.read.parquet(path)))
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with two pictures put behind its heading, its address and its own source: each item of the sequences, in its place."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    filled = lambda c: F.concat(c, F.repeat(F.lit(" "), F.when(F.octet_length(c) == 0, media.WIDTH).otherwise(F.pmod(-F.octet_length(c), F.lit(media.WIDTH)))))
    both = pages.withColumns({"__a": filled(F.col("url")), "__b": filled(F.col("html"))})
    path = media.write_media(both.select(F.explode(F.array(F.encode("__a", "utf-8"), F.encode("__b", "utf-8"))).alias("payload")), shared_path(spark, "media"))
    shown = lambda c, caption: F.concat(F.lit("<img src='" + media.SCHEME), F.sha2(c, 256), F.lit(f"' alt='{caption}'>"))
    figure = F.concat(F.lit("<figure>"), shown("__a", "address"), shown("__b", "source"), F.lit("<figcaption>Page "), F.col("page_id").cast("string"), F.lit("</figcaption></figure><p>behind</p>"))
    parts = F.split("html", "</h1>", 2)
    html = F.concat(F.get(parts, F.lit(0)), F.lit("</h1>"), figure, F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    found = media.resolve(media.interleave(both.select("page_id", html.alias("html"))), media.read_media(spark.read.parquet(path)))
    return found.select("page_id", "position", "kind", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "digest", "caption", "payload_bytes", "payload_sha256", "feature")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_simhash, op3_licenses, op4_secrets, op5_token_counts, op6_line_dedup, op7_decontamination, op8_packing, op9_token_files, op10_media, language_id_pages, media_pages)
}

_KEY = f"translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOWER}')"

SQL: dict[str, str] = {
    "op3_licenses": licenses.oracle(),
    "op6_line_dedup": f"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
said AS (SELECT r, doc_id, unnest(range(len(s))) AS i, unnest(s) AS l FROM cut),
keyed AS (SELECT r, doc_id, i, l, {_KEY} AS k FROM said),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT r, doc_id, i, l, c.k IS NOT NULL AND doc_id < c.last AS gone FROM keyed LEFT JOIN common c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""",
    "op7_decontamination": r"""
WITH fold AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
patterns AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS p
             FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM patterns),
runs AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS p
         FROM (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS i FROM fold, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM runs JOIN patterns USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS j FROM hits) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN words USING (doc_id) LEFT JOIN own USING (doc_id)""",
}
