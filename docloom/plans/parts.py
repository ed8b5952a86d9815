"""Registered queries over packs, pictures, addresses, formulas and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry
from ..functions.frames import stored
from ..operators import blocks, packs, retrieval
from ..sources import detect, registry
from . import assist, study
from .files import said, table

STAMP = "2024-01-01T00:00:00.000Z"


def plain_packs(spark, sf_dir):
    """Documents as plain packs, opened as study packs: Markdown alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"), F.col("lang").alias("title"), "source")
    opened = packs.unpack_study(packs.pack_plain(docs, F.lit(STAMP)).select("doc_id", "pack"))
    return opened.select("doc_id", "document.version", "document.title", F.md5("document.markdown").alias("markdown"), F.size("document.blocks").cast("long").alias("n_blocks"), F.coalesce("error", F.lit("")).alias("error"))


def merged_packs(spark, sf_dir):
    """Nations as study packs, those of a region merged into one."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("long").alias("merge_id"))
    docs = nation.select("doc_id", "title", said("# ", F.col("title"), "\n\nAbout ", F.col("title"), ".").alias("text"))
    made = stored(study.study_packs(docs, created_at=F.lit(STAMP)), "packs")
    sources = nation.select("doc_id", "merge_id", F.col("doc_id").cast("int").alias("source_no"), F.col("title").alias("label"))
    opened = packs.unpack_study(study.merge_packs(made, sources, F.lit(STAMP)))
    first = F.get("document.blocks", F.lit(0))["id"]
    return opened.select("doc_id", "document.title", F.md5("document.markdown").alias("markdown"), F.size("document.blocks").cast("long").alias("n_blocks"), first.alias("first_block"), F.get("document.warnings", F.lit(0)).alias("warning"))


def attached_images(spark, sf_dir):
    """Suppliers as blocks, each third a picture; three ranked rows of each nation ask for theirs."""
    made = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").cast("int").alias("ord"), said("s", F.col("s_suppkey").cast("string")).alias("block_id"), (F.col("s_suppkey") % 5).cast("int").alias("page"),
        F.when(F.col("s_suppkey") % 3 == 0, "image").otherwise("text").alias("kind"), F.col("s_name").alias("title"), said("data:", (F.col("s_suppkey") % 7).cast("string")).alias("data_url"),
    )
    ranked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("rank"), F.col("n_nationkey").alias("doc_id"))
    ranked = ranked.select("*", F.lit("c").alias("chunk_id"), said("s", (F.col("doc_id") + 3 * F.col("rank")).cast("string")).alias("block_id"), F.col("rank").alias("page"))
    cards = made.select("doc_id", said("f").alias("id"), F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("image_ids")).alias("solution"))
    found = retrieval.attach_images(ranked, cards, made)
    return found.select("query_id", F.col("n").cast("long").alias("n"), "src", "block_id")


def assisted_math(spark, sf_dir):
    text = said(F.col("p_size").cast("string"), "/", (F.col("p_partkey") % 9 + 1).cast("string"))
    return assist.math_with_model(table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))).select("p_partkey", "normalized", F.round("confidence", 6).alias("confidence"), "assisted")


def ion_formulas(spark, sf_dir):
    ion = said(F.when(F.col("c_custkey") % 2 == 0, "Cu").otherwise("Zn"), (F.col("c_custkey") % 3 + 2).cast("string"), "+")
    whole = said(ion, "(aq) + Fe(s) -> Cu(s)")
    return table(spark, sf_dir, "customer").select("c_custkey", chemistry.column(chemistry.plain_to_mhchem, ion).alias("ion"), chemistry.column(chemistry.plain_to_mhchem, whole).alias("reaction"), chemistry.column(chemistry.normalize_in_text, said("the metal is found in the ", F.col("c_name"), " of many salts")).alias("prose"))


def inline_uris(spark, sf_dir):
    uri = F.when(F.col("item_id") % 2 == 0, said("data:text/plain;charset=utf-8;base64,", F.base64(F.encode("text", "utf-8")))).otherwise(said("ftp://x.org/", F.col("item_id").cast("string")))
    read = registry.read_uris(table(spark, sf_dir, "benchmark").select("item_id", uri.alias("uri")))
    return read.select("item_id", F.coalesce(F.md5("content"), F.lit("")).alias("content"), F.coalesce("info.mimetype", F.lit("")).alias("mimetype"), F.coalesce("error", F.lit("")).alias("error"))


def mime_types(spark, sf_dir):
    """Types of extensions and back, with capitals and without the point, and one that isn't known."""
    known = ["TXT", ".csv", "html", ".pdf", "png", ".zip", ".odd"]
    ext = F.element_at(F.array(*map(F.lit, known)), (F.col("p_partkey") % 7 + 1).cast("int"))
    mime = detect.mime_from_extension(ext)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(mime, F.lit("")).alias("mimetype"), F.coalesce(detect.extension_from_mime(mime), F.lit("")).alias("extension"))


def next_block_numbers(spark, sf_dir):
    from .queries import markdown_of

    found = blocks.next_block_number(blocks.markdown_blocks(markdown_of(spark, sf_dir)))
    return found.select("doc_id", F.col("page").cast("long").alias("page"), F.col("next").cast("long").alias("next"))


QUERIES = {f.__name__: f for f in (plain_packs, merged_packs, attached_images, assisted_math, ion_formulas, inline_uris, mime_types, next_block_numbers)}

SQL: dict[str, str] = {
    "plain_packs": "SELECT doc_id, 1 AS version, lang AS title, md5(text) AS markdown, 0::BIGINT AS n_blocks, '' AS error FROM documents",
    "merged_packs": """
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, min_by(n_name, n_nationkey) AS title, md5(string_agg('## Merged from: ' || n_name || chr(10) || chr(10) || '# ' || n_name || chr(10) || chr(10) || 'About ' || n_name || '.', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n_nationkey)) AS markdown,
  2 * count(*) AS n_blocks, 'm' || min(n_nationkey) || '_md-p0-b0' AS first_block, 'Merged ' || count(*) || ' study packs: ' || string_agg(n_name, ', ' ORDER BY n_nationkey) AS warning FROM nation GROUP BY n_regionkey HAVING count(*) > 1""",
    "attached_images": """
WITH p AS (SELECT s_nationkey AS d, s_suppkey AS k, s_suppkey % 5 AS page, 'data:' || s_suppkey % 7 AS src FROM supplier WHERE s_suppkey % 3 = 0),
r AS (SELECT n_nationkey AS q, unnest([0, 1, 2]) AS rank FROM nation),
w AS (SELECT q, rank, 1 AS way, k, src FROM r JOIN p ON p.d = q AND p.page = rank UNION ALL SELECT q, rank, 2, k, src FROM r JOIN p ON p.d = q AND p.k = q + 3 * rank),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY q, src ORDER BY rank, way, k) = 1)
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY rank, way, k) - 1 AS n, src, 's' || k AS block_id FROM f QUALIFY n < 3""",
    "assisted_math": r"SELECT p_partkey, '$\frac{' || p_size || '}{' || (p_partkey % 9 + 1) || '}$' AS normalized, 0.75::DOUBLE AS confidence, false AS assisted FROM part",
    "ion_formulas": r"""
SELECT c_custkey, '\ce{' || i || '}' AS ion, '\ce{' || i || '(aq) + Fe(s) -> Cu(s)}' AS reaction, 'the metal is found in the ' || c_name || ' of many salts' AS prose
FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'Cu' ELSE 'Zn' END || '^{' || (c_custkey % 3 + 2) || '+}' AS i FROM customer)""",
    "inline_uris": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN md5(text) ELSE '' END AS content, CASE WHEN item_id % 2 = 0 THEN 'text/plain' ELSE '' END AS mimetype, CASE WHEN item_id % 2 = 0 THEN '' ELSE 'only data: and http(s): addresses' END AS error FROM benchmark",
    "mime_types": """
SELECT p_partkey, ['text/plain', 'text/csv', 'text/html', 'application/pdf', 'image/png', 'application/zip', ''][p_partkey % 7 + 1] AS mimetype, ['.txt', '.csv', '.html', '.pdf', '.png', '.zip', ''][p_partkey % 7 + 1] AS extension FROM part""",
}
