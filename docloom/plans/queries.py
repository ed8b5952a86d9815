"""The operators as queries over whole tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import chemistry, math_text
from ..functions import text as T
from ..functions.frames import spread, stored
from ..operators import blocks, cards, chunks, packs, retrieval, words
from ..sources import detect, registry
from ..streaming.ingest import event_windows
from . import files, parts, study


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def joined(c: str) -> Column:
    """An array of strings as one digest."""
    return F.md5(F.array_join(c, "\x01"))


# Scalar text functions


def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), joined("s").alias("digest"))


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def skippable_headings(spark, sf_dir):
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    lines = F.transform(F.split(upper, r"[\n.]"), T.trim_all)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, T.is_skippable_heading)).cast("long").alias("n_headings"))


def normalized_markdown(spark, sf_dir):
    padded = F.replace("text", F.lit("."), F.lit(". \n\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_markdown(padded)).alias("digest"))


def significant_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def search_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.search_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), joined("t").alias("digest"))


def card_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.card_key(F.col("text")).alias("key"), T.trim_answer(F.col("text"), 12).alias("answer"), T.is_meta_answer(F.col("text")).alias("meta"))


def collapsed_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    numbered = F.concat(F.lit(".1\n\n"), F.col("text"), F.lit("\n.2\nlast"))
    return docs.select("doc_id", F.md5(T.collapse_newlines(F.col("text"))).alias("one_line"), F.md5(T.merge_partial_numbering(numbered)).alias("numbered"))


def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("digest"), T.has_math_markup(F.col("html")).alias("has_math"))


def url_parts(spark, sf_dir):
    info = detect.response_info(F.lit("text/html; charset=UTF-8"), F.lit(None).cast("string"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", info.alias("i")).select("page_id", "i.mimetype", "i.charset", F.coalesce("i.filename", F.lit("")).alias("filename"), F.coalesce("i.extension", F.lit("")).alias("extension"))


def data_uris(spark, sf_dir):
    uri = F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), F.base64(F.encode("text", "utf-8")))
    read = table(spark, sf_dir, "benchmark").select("item_id", T.parse_data_uri(uri).alias("d"))
    return read.select("item_id", "d.mimetype", "d.charset", F.md5("d.content").alias("digest"))


def failure_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.explain_failure(F.col("text")).alias("failure"))


def chemistry_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    said = F.concat(F.substring("text", 1, 40), F.lit("\nZn(s) + Cu2+(aq) -> Zn2+(aq) + Cu(s)\n"), F.col("text"))
    return docs.select("doc_id", chemistry.column(chemistry.normalize_in_text, said).alias("text"))


def math_latex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chemistry.column(math_text.plain_to_latex, F.col("text")).alias("latex"))


# Detection and converters


def detected_formats(spark, sf_dir):
    html = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("source"), F.encode("html", "utf-8").alias("content"))
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents"), F.encode("text", "utf-8"))
    both = html.union(text)
    return both.select("id", "source", F.coalesce(detect.magic_extension(F.col("content")), F.lit("")).alias("extension"), detect.is_likely_text(F.col("content")).alias("is_text"))


def converted_pages(spark, sf_dir):
    return registry.convert_pages(table(spark, sf_dir, "pages"))


def nation_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("l", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select("n_regionkey", blocks.gfm_table(cells).alias("markdown"))


# Blocks, chunks and cards


def markdown_of(spark, sf_dir) -> DataFrame:
    """Documents as Markdown with a heading, their lines as paragraphs, a list and a table."""
    tail = F.concat(F.lit("\n\n- "), "lang", F.lit("\n- "), "source", F.lit("\n\n| id | lang |\n| --- | --- |\n| "), F.col("doc_id").cast("string"), F.lit(" | "), "lang", F.lit(" |"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), tail).alias("text"), F.col("source").alias("title"), "source")


def markdown_blocks(spark, sf_dir):
    made = blocks.markdown_blocks(markdown_of(spark, sf_dir))
    return made.select("doc_id", F.col("ord").cast("long").alias("ord"), "block_id", "type", F.md5("content").alias("digest"), F.round("bbox.y", 3).alias("y"))


def blocks_to_markdown(spark, sf_dir):
    made = blocks.study_blocks(blocks.markdown_blocks(markdown_of(spark, sf_dir)))
    return blocks.blocks_markdown(made).select("doc_id", F.md5("markdown").alias("digest"))


def block_chunks(spark, sf_dir):
    made = blocks.study_blocks(blocks.markdown_blocks(markdown_of(spark, sf_dir)))
    return chunks.chunk_blocks(made).select("doc_id", "chunk_id", "kind", F.md5("text").alias("digest"))


def text_chunks(spark, sf_dir):
    return chunks.chunk_texts(table(spark, sf_dir, "documents"))


def study_cards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = docs.select("doc_id", F.lit(0).alias("ord"), F.lit("b0").alias("block_id"), F.lit(0).alias("page"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"))
    return cards.flash_cards(made)


def qa_blocks(spark, sf_dir) -> DataFrame:
    """A question and answer block for each user turn that an assistant turn follows."""
    turns = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order)).filter("role = 'user' and next_role = 'assistant'")
    made = pairs.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.concat(F.lit("b"), F.col("turn").cast("string")).alias("block_id"), (F.col("turn") / 4).cast("int").alias("page"), F.lit("qa").alias("kind"), F.lit(None).cast("string").alias("title"), F.col("text").alias("question"), "answer")
    return made.withColumn("content", T.qa_content(F.col("question"), F.col("answer")))


def qa_pairs(spark, sf_dir):
    made = qa_blocks(spark, sf_dir)
    parsed = T.parse_qa(F.col("content"))
    return made.select("doc_id", F.col("ord").cast("long").alias("ord"), "block_id", F.md5("content").alias("content"), F.md5(parsed["question"]).alias("question"), F.md5(parsed["answer"]).alias("answer"))


def qa_cards(spark, sf_dir):
    made = cards.flash_cards(qa_blocks(spark, sf_dir))
    return made.select("doc_id", F.col("ord").cast("long").alias("ord"), "id", F.col("page").cast("long").alias("page"), F.md5("info").alias("info"), F.md5("solution.text").alias("answer"))


def qa_mcqs(spark, sf_dir):
    # All turns of ten conversations are one document, so that documents have enough cards.
    made = qa_blocks(spark, sf_dir).withColumn("ord", (F.col("doc_id") % 10 * 1000 + F.col("ord")).cast("int")).withColumn("block_id", F.concat("block_id", F.lit("-"), F.col("doc_id").cast("string"))).withColumn("doc_id", F.floor(F.col("doc_id") / 10))
    return cards.mcqs(cards.flash_cards(made))


def reading_order(spark, sf_dir):
    """Every word as a block, 200 on a page, set out in crooked lines."""
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "content"))
    place = F.pmod(F.col("i"), F.lit(200))
    box = F.struct(F.pmod(place * 37, F.lit(11)).cast("double").alias("x"), (F.floor(place / 7) * 9 + F.pmod(place, F.lit(3))).cast("double").alias("y"), F.lit(5.0).alias("w"), F.lit(6.0).alias("h"))
    made = blocks.reading_order(parts.select("doc_id", F.floor(F.col("i") / 200).cast("int").alias("page"), "i", "content", box.alias("bbox")))
    return made.select("doc_id", F.col("page").cast("long").alias("page"), F.col("i").cast("long").alias("i"), F.col("ord").cast("long").alias("ord"), "block_id")


def page_words(spark, sf_dir) -> DataFrame:
    """All words of documents, set in a grid of four columns, 200 on a page."""
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("word_ix", "text"))
    place = F.pmod(F.col("word_ix"), F.lit(200))
    x, y = F.pmod(place, F.lit(4)) * 140.0 + 20, F.floor(place / 4) * 15.0 + 30
    return parts.select("doc_id", F.floor(F.col("word_ix") / 200).cast("int").alias("page"), "word_ix", "text", x.alias("x0"), (x + 60).alias("x1"), y.alias("top"), (y + 10).alias("bottom"))


def word_rows(spark, sf_dir):
    found = words.word_rows(page_words(spark, sf_dir))
    return found.select("doc_id", F.col("page").cast("long").alias("page"), F.col("row_no").cast("long").alias("row_no"), "y", "text", "is_paragraph", "is_numbering", F.array_join(F.transform("groups", lambda x: x.cast("int").cast("string")), ",").alias("groups"))


def form_segments(spark, sf_dir):
    found = words.form_segments(page_words(spark, sf_dir))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return found.select("doc_id", F.col("page").cast("long").alias("page"), F.col("ord").cast("long").alias("ord"), "type", "y", F.md5(rows).alias("rows"), F.md5("text").alias("text"))


def region_text(spark, sf_dir):
    """Two regions of every page."""
    found = page_words(spark, sf_dir)
    regions = found.select("doc_id", "page").distinct().select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("region_id"))
    box = F.struct((F.col("region_id") * 280.0).alias("x"), F.lit(25.0).alias("y"), F.lit(250.0).alias("w"), F.lit(100.0).alias("h"))
    read = words.region_text(found, regions.withColumn("bbox", box))
    return read.select("doc_id", F.col("page").cast("long").alias("page"), F.col("region_id").cast("long").alias("region_id"), F.md5("text").alias("digest"))


def page_lines(spark, sf_dir) -> DataFrame:
    """Every line of documents as a line of a page, in fonts of nine sizes."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    place = F.col("line_no").cast("double")
    return lines.select("doc_id", F.lit(0).alias("page"), "line_no", "text", (F.pmod(F.col("line_no") * 7, F.lit(9)) + 10).cast("double").alias("font_size"), F.lit(0.0).alias("x"), (place * 20).alias("y"), F.lit(500.0).alias("w"), F.lit(12.0).alias("h"))


def line_kinds(spark, sf_dir):
    made = words.line_blocks(page_lines(spark, sf_dir))
    return made.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "type", F.md5("content").alias("content"), F.coalesce("title", F.lit("")).alias("title"))


def joined_characters(spark, sf_dir):
    """The characters of benchmark items, six units wide, as words."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", "")).alias("char_ix", "char")).filter("char <> ''")
    x = F.col("char_ix") * 6.0
    made = words.chars_to_words(items.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("line"), "char_ix", "char", x.alias("x0"), (x + 6).alias("x1"), F.lit(1.0).alias("top"), F.lit(9.0).alias("bottom")))
    return made.select("doc_id", F.col("word_ix").cast("long").alias("word_ix"), "text", "x0", "x1")


def region_segments(spark, sf_dir):
    """Customers' boxes as segments, and as regions a little aside: the segment that covers most of each region."""
    base = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.pmod("c_custkey", F.lit(40)).cast("int").alias("page"), F.col("c_custkey").alias("k"))
    place = F.pmod(F.col("k") * 13, F.lit(50)).cast("double")
    box = lambda x: F.struct(x.alias("x"), (place * 3).alias("y"), F.lit(20.0).alias("w"), F.lit(10.0).alias("h"))
    found = words.largest_overlap(base.select("doc_id", "page", F.col("k").alias("segment_id"), box(place).alias("bbox")), base.select("doc_id", "page", F.col("k").alias("region_id"), box(place + 7).alias("bbox")))
    return found.select("doc_id", F.col("page").cast("long").alias("page"), "region_id", "segment_id")


def applied_edits(spark, sf_dir):
    """Two edits of every block, of which the later counts; it removes each fourth block."""
    made = blocks.markdown_blocks(markdown_of(spark, sf_dir)).select("doc_id", "ord", "block_id", "type", "content")
    log = made.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    edits = log.select("doc_id", "ord", "block_id", "type", F.concat(F.lit("edit "), F.col("seq").cast("string"), F.lit(" of "), F.col("content")).alias("content"), F.when((F.pmod("ord", F.lit(4)) == 3) & (F.col("seq") == 2), "remove").otherwise("upsert").alias("op"), F.lit(0).alias("ts"), "seq")
    return blocks.apply_edits(made, edits).select("doc_id", F.col("ord").cast("long").alias("ord"), "block_id", F.md5("content").alias("digest"))


# Retrieval


def _docs_as_corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _items_as_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_topk(spark, sf_dir):
    found = retrieval.lexical_topk(_docs_as_corpus(spark, sf_dir), _items_as_queries(spark, sf_dir))
    return found.select("query_id", "chunk_id", "bm25", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def lexical_prefix_topk(spark, sf_dir):
    found = retrieval.lexical_topk(_docs_as_corpus(spark, sf_dir), _items_as_queries(spark, sf_dir), prefix=True)
    return found.select("query_id", "chunk_id", "bm25", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def indexed_topk(spark, sf_dir):
    """lexical_topk from postings that were written before, without the texts."""
    index = stored(retrieval.terms_table(_docs_as_corpus(spark, sf_dir)), "index", retrieval.POSTINGS)
    found = retrieval.lexical_topk(None, _items_as_queries(spark, sf_dir), index=index)
    return found.select("query_id", "chunk_id", "bm25", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_topk(spark, sf_dir):
    corpus = _vectors(spark, sf_dir)
    asked = corpus.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return retrieval.vector_topk(corpus, asked).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def approximate_vector_topk(spark, sf_dir):
    corpus = _vectors(spark, sf_dir)
    return retrieval.approximate_topk(corpus, corpus.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"))


def _hybrid_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    corpus = _docs_as_corpus(spark, sf_dir).join(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    return corpus, _items_as_queries(spark, sf_dir).join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def hybrid_fusion(spark, sf_dir):
    corpus, asked = _hybrid_sides(spark, sf_dir)
    lexical = retrieval.lexical_topk(corpus, asked)
    vector = retrieval.vector_topk(corpus, asked).filter(F.col("score") >= DEFAULTS.min_vector_score)
    return retrieval.fuse(vector, lexical).select("query_id", "chunk_id", "score", "vector_score", F.col("rank").cast("long").alias("rank"))


def hybrid_retrieval(spark, sf_dir):
    corpus, asked = _hybrid_sides(spark, sf_dir)
    return retrieval.retrieve(corpus, asked)


def gated_passages(spark, sf_dir):
    """hybrid_retrieval without nulls, and with digests for texts."""
    found = hybrid_retrieval(spark, sf_dir)
    return found.select(
        "query_id", F.coalesce(F.col("rank").cast("long"), F.lit(-1)).alias("rank"), F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        F.coalesce("score", F.lit(-1.0)).alias("score"), F.coalesce("vector_score", F.lit(-1.0)).alias("vector_score"), F.round(F.coalesce("overlap", F.lit(-1.0)), 6).alias("overlap"), "reason", "mode",
    )


def chunk_digests(spark, sf_dir):
    """text_chunks with digests for texts."""
    return text_chunks(spark, sf_dir).select("doc_id", "chunk_id", F.md5("text").alias("digest"))


def relevance_gate(spark, sf_dir):
    corpus, asked = _docs_as_corpus(spark, sf_dir), _items_as_queries(spark, sf_dir)
    ranked = retrieval.lexical_topk(corpus, asked, 3).withColumn("vector_score", F.lit(None).cast("double"))
    gate = retrieval.relevance(retrieval.with_overlap(ranked, asked, corpus), asked)
    return gate.select("query_id", "relevant", "reason", F.round("best_lexical_overlap", 6).alias("best_lexical_overlap"))


def answers(spark, sf_dir):
    corpus, asked = _hybrid_sides(spark, sf_dir)
    return study.answer(corpus, asked).select("query_id", "answer", "mode", "reason")


def search_corpus(spark, sf_dir):
    docs = markdown_of(spark, sf_dir)
    found = study.corpus_of(docs, study.study_tables(docs))
    return found.select("doc_id", "chunk_id", F.md5("text").alias("digest"))


# Packs


def conversation_stats(spark, sf_dir):
    made = qa_blocks(spark, sf_dir)
    docs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return packs.stats(docs, {"blocks": made, "flash_cards": cards.flash_cards(made)})


def merged_blocks(spark, sf_dir):
    made = qa_blocks(spark, sf_dir).select("doc_id", "ord", "block_id", "content")
    docs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    sources = docs.select("doc_id", F.floor(F.col("doc_id") / 4).alias("merge_id"), (F.col("doc_id") % 4).cast("int").alias("source_no"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("label"))
    merged = packs.merge_tables(sources, {"blocks": made})["blocks"]
    return merged.select("doc_id", F.col("ord").cast("long").alias("ord"), "block_id", F.md5("content").alias("digest"))


def packed_studies(spark, sf_dir):
    """Packs written and read again: what comes out."""
    docs = markdown_of(spark, sf_dir)
    opened = packs.unpack_study(study.study_packs(docs, created_at=F.lit("2024-01-01T00:00:00.000Z")))
    sizes = {n: F.size(f"document.{f}").cast("long").alias(f"n_{n}") for n, f in packs.TABLES.items() if n != "games"}
    return opened.select("doc_id", "document.version", "document.title", F.md5("document.markdown").alias("markdown"), *sizes.values(), "error")


# Events, as a stream would count them


def event_counts(spark, sf_dir):
    return event_windows(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("value", 2).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sentence_split, token_estimate, skippable_headings, normalized_markdown, significant_terms, search_tokens, card_keys, collapsed_lines, html_escaped, url_parts, data_uris, failure_classes, chemistry_text, math_latex,
        detected_formats, converted_pages, nation_tables, markdown_blocks, blocks_to_markdown, block_chunks, text_chunks, chunk_digests, study_cards, qa_pairs, qa_cards, qa_mcqs, reading_order, word_rows, form_segments, region_text, line_kinds, joined_characters, region_segments, applied_edits,
        lexical_topk, lexical_prefix_topk, indexed_topk, vector_topk, approximate_vector_topk, hybrid_fusion, hybrid_retrieval, gated_passages, relevance_gate, answers, search_corpus, conversation_stats, merged_blocks, packed_studies, event_counts,
    )
} | files.QUERIES | parts.QUERIES

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
_TERMS = rf"list_filter(regexp_split_to_array(lower({{}}), '\W+'), lambda t: length(t) > 2 AND t NOT IN ({_STOP}))"


def _heading(s: str) -> str:
    letters, upper = f"length(regexp_replace({s}, '[^a-zA-Z]', '', 'g'))", f"length(regexp_replace({s}, '[^A-Z]', '', 'g'))"
    return rf"(regexp_matches({s}, '^\d+(?:\.\d+)*\s+THE\s+[A-Z][A-Z0-9\s\-]{{8,}}\.?$') OR ({letters} >= 15 AND {upper} / greatest({letters}, 1) >= 0.72 AND length({s}) < 140 AND NOT regexp_matches({s}, '(?i)\b(is|are|was|called|include|located)\b')))"


def _sentences(source: str, keys: str, text: str) -> str:
    return rf"""parts AS (SELECT {keys}, list_transform(string_split(regexp_replace(regexp_replace({text}, '\n+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: {_TRIM.format("p")}) AS p FROM {source}),
kept AS (SELECT {keys}, list_filter(p, lambda x: length(x) >= 24 AND NOT {_heading("x")}) AS p FROM parts),
cut AS (SELECT {keys}, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 2048 THEN [x] ELSE list_filter(list_transform(range(CAST(ceil(length(x) / 2048) AS BIGINT)), lambda i: {_TRIM.format("substring(x, i * 2048 + 1, 2048)")}), lambda s: s <> '') END)) AS s FROM kept)"""


_SENTENCES = _sentences("documents", "doc_id", "text")


def _windows(source: str, keys: str) -> str:
    """chunked: keys, i and text, of source with keys and s, the sentences."""
    return rf"""counted AS (SELECT {keys}, s, list_transform(s, lambda x: CAST(ceil(length({_TRIM.format('x')}) / 4.0) AS BIGINT)) AS t FROM {source} WHERE len(s) > 0),
pre AS (SELECT {keys}, s, len(s) AS n, list_transform(range(len(s) + 1), lambda k: coalesce(list_sum(list_slice(t, 1, k)), 0)) AS p FROM counted),
walk AS (
  SELECT {keys}, 0 AS i, 0::BIGINT AS a, greatest(1, coalesce(list_max(list_filter(range(1, n + 1), lambda e: p[e + 1] <= 512)), 1)) AS b FROM pre
  UNION ALL
  SELECT {keys}, i + 1, a2, greatest(a2 + 1, coalesce(list_max(list_filter(range(a2 + 1, n + 1), lambda e: p[e + 1] - p[a2 + 1] <= 512)), a2 + 1))
  FROM (SELECT {keys}, i, n, p, greatest(a + 1, coalesce(list_max(list_filter(range(a, b), lambda o: p[b + 1] - p[o + 1] >= 64)), a)) AS a2 FROM walk w JOIN pre USING ({keys}) WHERE b < n)),
chunked AS (SELECT {keys}, i, {_TRIM.format("array_to_string(list_slice(s, a + 1, b), ' ')")} AS text FROM walk JOIN pre USING ({keys}))"""


_QA = """pairs AS (SELECT conv_id AS doc_id, turn, text AS q, a FROM (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant')"""
_CARDS = rf"""{_QA},
clean AS (SELECT doc_id, turn, turn // 4 AS page, {_TRIM.format("q")} AS q, {_TRIM.format("a")} AS a FROM pairs),
keyed AS (SELECT *, left({_COLLAPSE.format("lower(q)")}, 96) AS k FROM clean WHERE q <> '' AND a <> ''),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY page, turn) AS f FROM keyed) WHERE f = 1),
cards AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, turn) - 1 AS n FROM firsts)"""
_MARKDOWN = "('# ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '- ' || lang || chr(10) || '- ' || source || chr(10) || chr(10) || '| id | lang |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |')"
_BLOCKS = rf"""md AS (SELECT doc_id, {_TRIM.format(_MARKDOWN)} AS t FROM documents),
parts AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS p FROM (SELECT doc_id, string_split(regexp_replace(t, '\n{{2,}}', chr(1), 'g'), chr(1)) AS p FROM md)),
lined AS (SELECT doc_id, i, list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS l FROM parts WHERE {_TRIM.format("p")} <> ''),
celled AS (SELECT *, list_transform(l, lambda x: list_transform(string_split(regexp_replace({_TRIM.format("x")}, '^\||\|$', '', 'g'), '|'), lambda c: {_TRIM.format("c")})) AS cells FROM lined),
typed AS (SELECT *, CASE WHEN len(l) = 1 AND regexp_matches(l[1], '^#{{1,6}}\s+.+$') THEN 'heading'
  WHEN len(l) >= 2 AND len(list_filter(range(1, len(l) + 1), lambda k: contains(l[k], '|') AND (regexp_matches({_TRIM.format("l[k]")}, '^\|?\s*:?-{{3,}}') OR len(list_filter(cells[k], lambda c: c <> '')) >= 2))) = len(l) THEN 'table'
  WHEN len(list_filter(l, lambda x: regexp_matches(x, '^\s*([-*+]|\d+\.)\s+'))) = len(l) THEN 'list' ELSE 'text' END AS type,
  list_filter(range(1, len(l) + 1), lambda k: NOT regexp_matches({_TRIM.format("l[k]")}, '^\|?\s*:?-{{3,}}') AND len(list_filter(cells[k], lambda c: c <> '')) > 0) AS kept FROM celled),
made AS (SELECT doc_id, i, type, l, kept, CASE type WHEN 'heading' THEN {_TRIM.format(r"regexp_extract(l[1], '^#{1,6}\s+(.+)$', 1)")}
  WHEN 'table' THEN array_to_string(list_transform(kept, lambda k: '| ' || array_to_string(cells[k], ' | ') || ' |'), chr(10))
  WHEN 'list' THEN array_to_string(list_filter(list_transform(l, lambda x: {_TRIM.format(r"regexp_replace(x, '^\s*([-*+]|\d+\.)\s+', '')")}), lambda x: x <> ''), chr(10))
  ELSE {_TRIM.format("array_to_string(l, chr(10))")} END AS content FROM typed),
sized AS (SELECT *, CASE type WHEN 'heading' THEN 28.0 WHEN 'table' THEN greatest(40.0, 18.0 * len(kept)) WHEN 'list' THEN greatest(24.0, 18.0 * len(l)) ELSE greatest(24.0, least(200.0, length(content) / 4.0)) END AS h FROM made WHERE content <> ''),
blocks AS (SELECT doc_id, row_number() OVER w - 1 AS ord, type, content, 48 + coalesce(sum(greatest(24.0, h + 8)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def _bm25(k: int, prefix: bool = False) -> str:
    meets = "starts_with(tf.t, a.t)" if prefix else "tf.t = a.t"
    return rf"""terms AS (SELECT doc_id AS c, {_TERMS.format("text")} AS ts FROM documents),
size AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM terms),
tf AS (SELECT c, len AS dl, t, count(*) AS tf FROM (SELECT c, len(ts) AS len, unnest(ts) AS t FROM terms) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS q, unnest({_TERMS.format("text")}) AS t FROM benchmark),
vocabulary AS (SELECT a.t AS asked, tf.t FROM (SELECT DISTINCT t FROM q) a JOIN (SELECT DISTINCT t FROM tf) tf ON {meets}),
met AS (SELECT asked AS t, c, dl, tf FROM vocabulary JOIN tf USING (t)),
df AS (SELECT t, count(DISTINCT c) AS df FROM met GROUP BY t),
scored AS (SELECT q, c, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS s FROM q JOIN met USING (t) JOIN df USING (t), size GROUP BY q, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) - 1 AS r FROM scored QUALIFY r < {k}),
lexical AS (SELECT q, c, s, r, (count(*) OVER (PARTITION BY q) - r) / count(*) OVER (PARTITION BY q) AS score FROM ranked)"""


_TOP = f"WITH {_bm25(8)} SELECT q AS query_id, c AS chunk_id, s AS bm25, r AS rank, round(score, 6) AS score FROM lexical"
#: Words of documents in a grid of four columns, 200 on a page; and these as rows.
_PLACED = r"""w AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS t FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents)),
placed AS (SELECT doc_id, i // 200 AS page, i, t, (i % 4) * 140 + 20 AS x, (i % 200 // 4) * 15 + 30 AS y FROM w)"""
_ROWS = rf"""{_PLACED},
gathered AS (SELECT doc_id, page, y, list(t ORDER BY x) AS ts, list(x ORDER BY x) AS xs FROM placed GROUP BY ALL),
rows AS (SELECT doc_id, page, y, ts, xs, row_number() OVER (PARTITION BY doc_id, page ORDER BY y) - 1 AS row_no, array_to_string(ts, ' ') AS text,
  xs[-1] + 60 - xs[1] > 336.6 AND length(array_to_string(ts, ' ')) > 60 AS is_paragraph, regexp_matches(ts[1], '^\.\d+$') AS is_numbering FROM gathered)"""


_FUSED = f"""{_bm25(8)},
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT item_id AS q, d.doc_id AS c, round(list_cosine_similarity(x.e, y.e), 6) AS s FROM benchmark b JOIN e x ON x.vec_id = b.item_id, documents d JOIN e y ON y.vec_id = d.doc_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM near WHERE s > -1) WHERE r <= 8 AND s >= 0.45),
arms AS (SELECT q, c, score AS s, NULL::DOUBLE AS v FROM lexical UNION ALL SELECT q, c, s, s FROM top),
lists AS (SELECT q, c, v, s, min(s) OVER w AS lo, max(s) OVER w AS hi FROM arms WINDOW w AS (PARTITION BY q, v IS NULL)),
summed AS (SELECT q, c, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END), 6) AS score, max(v) AS vector_score FROM lists GROUP BY q, c),
fused AS (SELECT q, c, score, vector_score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) - 1 AS rank FROM summed QUALIFY rank < 3)"""
#: The share of the terms ts that a text with lower-case form low and words ws holds, or nearly holds.
_OVERLAP = "CASE WHEN len(ts) = 0 THEN 0 ELSE len(list_filter(ts, lambda t: contains(low, t) OR (length(t) >= 6 AND len(list_filter(ws, lambda w: length(w) >= 4 AND abs(length(w) - length(t)) <= CASE WHEN length(t) >= 8 THEN 2 ELSE 1 END AND levenshtein(t, w) <= CASE WHEN length(t) >= 8 THEN 2 ELSE 1 END)) > 0))) / len(ts) END"

SQL: dict[str, str] = {
    "sentence_split": f"WITH {_SENTENCES} SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(1))) AS digest FROM cut",
    "chunk_digests": f"WITH RECURSIVE {_SENTENCES}, {_windows('cut', 'doc_id')} SELECT doc_id, 'md-' || i AS chunk_id, md5(text) AS digest FROM chunked",
    "text_chunks": f"WITH RECURSIVE {_SENTENCES}, {_windows('cut', 'doc_id')} SELECT doc_id, 'md-' || i AS chunk_id, 1 AS page, 'text' AS kind, text FROM chunked",
    "block_chunks": f"""WITH RECURSIVE {_BLOCKS.replace("parts AS", "split AS").replace("FROM parts", "FROM split")}, {_sentences("blocks", "doc_id, ord, type, content", "content")},
told AS (SELECT doc_id, ord, type, CASE WHEN len(s) > 0 THEN s WHEN length(content) >= 12 THEN [left(content, 2048)] ELSE [] END AS s FROM cut), {_windows("told", "doc_id, ord, type")}
SELECT doc_id, 'md-p0-b' || ord || '_c' || i AS chunk_id, type AS kind, md5(text) AS digest FROM chunked""",
    "blocks_to_markdown": rf"""WITH {_BLOCKS}
SELECT doc_id, md5(regexp_replace(string_agg(CASE WHEN type = 'heading' AND NOT starts_with(content, '#') THEN '# ' || content ELSE content END, chr(10) || chr(10) ORDER BY ord), '(?m)^[ \t\r\f\v]*(\.\d+)[ \t\r\f\v]*\n\s*(\S)', '\1 \2', 'g')) AS digest FROM blocks GROUP BY doc_id""",
    "token_estimate": f"SELECT doc_id, CAST(ceil(length({_TRIM.format('text')}) / 4.0) AS BIGINT) AS tokens FROM documents",
    "skippable_headings": rf"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[\n.]'), lambda p: {_TRIM.format('p')}), lambda x: {_heading('x')})) AS n_headings FROM documents",
    "normalized_markdown": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, '.', '. ' || chr(10) || chr(10) || chr(10)), '[ \t\r\f\v]+\n', chr(10), 'g'), '[ \t\r\f\v]+$', ''), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents",
    "significant_terms": f"SELECT item_id, array_to_string({_TERMS.format('text')}, ' ') AS terms FROM benchmark",
    "search_tokens": r"""
WITH said AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s,;:.!?()\[\]{}"''`|\\/<>@#$%^&*+=~]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '[a-z]')) AS t FROM documents),
firsts AS (SELECT doc_id, t, list_slice(list_filter(range(1, len(t) + 1), lambda i: list_position(t, t[i]) = i), 1, 80) AS pos FROM said)
SELECT doc_id, len(pos) AS n_tokens, md5(array_to_string(list_transform(pos, lambda i: t[i]), chr(1))) AS digest FROM firsts""",
    "card_keys": rf"""
SELECT doc_id, left({_COLLAPSE.format("lower(text)")}, 96) AS key,
  CASE WHEN regexp_matches(c, '\\ce\{{|\\pu\{{|\$') AND length(c) <= 320 THEN c ELSE array_to_string(string_split(c, ' ')[1:12], ' ') END AS answer,
  regexp_matches({_TRIM.format("text")}, '(?i)^(i (don''t|do not)|as an ai|cannot determine|not (enough|sufficient)|n/a)') AS meta
FROM (SELECT doc_id, text, {_COLLAPSE.format("text")} AS c FROM documents)""",
    "collapsed_lines": rf"""
SELECT doc_id, md5({_TRIM.format(r"regexp_replace(text, '\s*\n+\s*', ' ', 'g')")}) AS one_line,
  md5(regexp_replace('.1' || chr(10) || chr(10) || text || chr(10) || '.2' || chr(10) || 'last', '(?m)^[ \t\r\f\v]*(\.\d+)[ \t\r\f\v]*\n\s*(\S)', '\1 \2', 'g')) AS numbered FROM documents""",
    "html_escaped": r"""
SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest,
  regexp_matches(html, '\$\$(?s:.+?)\$\$|\$[^$\n]+\$|\\\((?s:.+?)\\\)|\\\[(?s:.+?)\\\]|\\ce\s*\{|\\pu\s*\{') AS has_math FROM pages""",
    "url_parts": r"""
SELECT page_id, 'text/html' AS mimetype, 'UTF-8' AS charset, CASE WHEN contains(f, '.') THEN f ELSE '' END AS filename, CASE WHEN contains(f, '.') THEN lower(regexp_extract(f, '^.+(\.[^.]*)$', 1)) ELSE '' END AS extension
FROM (SELECT page_id, string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')[-1] AS f FROM pages)""",
    "data_uris": "SELECT item_id, 'text/plain' AS mimetype, 'utf-8' AS charset, md5(text) AS digest FROM benchmark",
    "failure_classes": r"""
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'unknown'
  WHEN regexp_matches(lower(text), 'enospc|no space|not enough space|quotaexceeded|quota exceeded|storage.*full|disk.*(full|space)|out of (disk|storage)|domexception.*(quota|22)') THEN 'disk'
  WHEN regexp_matches(lower(text), 'out of memory|oom|cannot allocate|memory (limit|pressure)|wasm.*memory|array buffer allocation failed|failed to allocate') THEN 'memory'
  WHEN regexp_matches(lower(text), 'timed out|timeout') THEN 'timeout'
  WHEN regexp_matches(lower(text), 'network|fetch failed|failed to fetch|net::|econnreset|enotfound|offline|503|502|500|404') THEN 'network'
  WHEN regexp_matches(lower(text), 'corrupt|invalid|gguf|magic|truncated|unexpected end|incomplete') THEN 'corrupt' ELSE 'other' END AS failure FROM documents""",
    "detected_formats": r"""
WITH b AS (SELECT page_id AS id, 'pages' AS source, html AS t FROM pages UNION ALL SELECT doc_id, 'documents', text FROM documents)
SELECT id, source, CASE WHEN starts_with(lower(ltrim(left(t, 256))), '<!doctype html') OR starts_with(lower(ltrim(left(t, 256))), '<html') THEN '.html' WHEN left(t, 1) IN ('{', '[') THEN '.json' ELSE '' END AS extension,
  length(t) > 0 AND NOT regexp_matches(left(t, 4096), '[\x00-\x08]') AS is_text FROM b""",
    "nation_tables": r"""
WITH r AS (SELECT n_regionkey, n_nationkey AS o, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation),
w AS (SELECT n_regionkey, CAST(greatest(3, max(length(a))) AS INTEGER) AS wa, CAST(greatest(4, max(length(b))) AS INTEGER) AS wb FROM r GROUP BY 1)
SELECT n_regionkey, '| ' || rpad('key', any_value(wa), ' ') || ' | ' || rpad('name', any_value(wb), ' ') || ' |' || chr(10) || '| ' || repeat('-', any_value(wa)) || ' | ' || repeat('-', any_value(wb)) || ' |' || chr(10)
  || string_agg('| ' || rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ') || ' |', chr(10) ORDER BY o) AS markdown
FROM r JOIN w USING (n_regionkey) GROUP BY n_regionkey""",
    "markdown_blocks": f"WITH {_BLOCKS} SELECT doc_id, ord, 'md-p0-b' || ord AS block_id, type, md5(content) AS digest, CAST(round(y, 3) AS DOUBLE) AS y FROM blocks",
    "applied_edits": f"""WITH {_BLOCKS}
SELECT doc_id, ord, 'md-p0-b' || ord AS block_id, md5('edit 2 of ' || content) AS digest FROM blocks WHERE ord % 4 <> 3""",
    "qa_pairs": rf"""WITH {_QA}, clean AS (SELECT doc_id, turn, {_TRIM.format("q")} AS q, {_TRIM.format("a")} AS a FROM pairs)
SELECT doc_id, turn AS ord, 'b' || turn AS block_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN q <> '' THEN '**Q:** ' || q END, CASE WHEN a <> '' THEN '**A:** ' || a END)) AS content, md5(q) AS question, md5(a) AS answer FROM clean""",
    "qa_cards": rf"""WITH {_CARDS}
SELECT doc_id, n AS ord, 'fc-b' || turn || '-' || n AS id, page, md5(CASE WHEN ends_with(q, '?') THEN q ELSE q || '?' END) AS info,
  md5(CASE WHEN regexp_matches(c, '\\ce\{{|\\pu\{{|\$') AND length(c) <= 320 THEN c ELSE array_to_string(string_split(c, ' ')[1:60], ' ') END) AS answer
FROM (SELECT *, {_COLLAPSE.format("a")} AS c FROM cards)""",
    "reading_order": r"""
WITH p AS (SELECT doc_id, unnest(range(len(w))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
b AS (SELECT doc_id, i, i // 200 AS page, (i % 200 * 37) % 11 AS x, (i % 200 // 7) * 9 + i % 200 % 3 AS y FROM p),
d AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x) > 4 THEN 1 ELSE 0 END AS s FROM b),
l AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS line FROM d),
o AS (SELECT doc_id, page, i, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, x, y) - 1 AS ord FROM l)
SELECT doc_id, page, i, ord, 'p' || page || '-b' || ord AS block_id FROM o""",
    "region_text": rf"""
WITH {_PLACED},
r AS (SELECT p.*, g.region_id FROM placed p, (VALUES (0), (1)) AS g(region_id) WHERE x + 60 >= region_id * 280 - 2 AND x <= region_id * 280 + 252 AND least(y + 10, 125) - greatest(y, 25) >= 5),
l AS (SELECT doc_id, page, region_id, floor(y / 5.0 + 0.5) AS k, string_agg(t, ' ' ORDER BY x, i) AS line FROM r GROUP BY ALL)
SELECT doc_id, page, CAST(region_id AS BIGINT) AS region_id, md5(string_agg(line, chr(10) ORDER BY k)) AS digest FROM l GROUP BY doc_id, page, region_id""",
    "word_rows": f"WITH {_ROWS} SELECT doc_id, page, row_no, CAST(y AS DOUBLE) AS y, text, is_paragraph, is_numbering, array_to_string(xs, ',') AS groups FROM rows",
    "form_segments": rf"""
WITH {_ROWS},
starts AS (SELECT doc_id, page, list_sort(list_distinct(flatten(list(xs)))) AS columns FROM rows WHERE NOT is_paragraph AND len(xs) >= 3 GROUP BY ALL),
flagged AS (SELECT r.*, NOT is_paragraph AND NOT is_numbering AND len(list_filter(columns, lambda c: list_contains(xs, c))) >= 2 AS aligned, columns FROM rows r JOIN starts USING (doc_id, page)),
shares AS (SELECT *, avg(CAST(aligned AS INT)) OVER (PARTITION BY doc_id, page) AS share FROM flagged),
marked AS (SELECT *, CASE WHEN aligned AND lag(aligned, 1, false) OVER w THEN 0 ELSE 1 END AS begins FROM shares WHERE share >= 0.2 WINDOW w AS (PARTITION BY doc_id, page ORDER BY row_no)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, page ORDER BY row_no) - 1 AS ord FROM marked),
cells AS (SELECT *, array_to_string(list_transform(columns, lambda c: coalesce(ts[list_position(xs, c)], '')), '|') AS line FROM numbered)
SELECT doc_id, page, CAST(ord AS BIGINT) AS ord, CASE WHEN any_value(aligned) THEN 'table' ELSE 'text' END AS type, CAST(min(y) AS DOUBLE) AS y,
  md5(CASE WHEN any_value(aligned) THEN string_agg(line, chr(10) ORDER BY row_no) ELSE '' END) AS rows, md5(CASE WHEN any_value(aligned) THEN '' ELSE any_value(text) END) AS text FROM cells GROUP BY doc_id, page, ord""",
    "line_kinds": rf"""
WITH l AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
t AS (SELECT doc_id, line_no, trim(raw) AS t, line_no * 7 % 9 + 10 AS size FROM l WHERE trim(raw) <> ''),
m AS (SELECT doc_id, list_sort(list(size)) AS s FROM t GROUP BY doc_id)
SELECT doc_id, line_no, kind AS type, md5(t) AS content, CASE WHEN kind = 'heading' THEN left(t, 80) ELSE '' END AS title
FROM (SELECT *, CASE WHEN regexp_matches(t, '^(?:[-*+•▪◦]|\d+[.)])\s+') THEN 'list' WHEN size >= 1.35 * s[len(s) // 2 + 1] AND length(t) < 200 THEN 'heading' ELSE 'text' END AS kind FROM t JOIN m USING (doc_id))""",
    "joined_characters": r"""
WITH c AS (SELECT item_id AS doc_id, unnest(range(length(text))) AS i, text FROM benchmark),
n AS (SELECT doc_id, i, substring(text, i + 1, 1) AS ch FROM c),
s AS (SELECT *, CASE WHEN NOT regexp_matches(ch, '\s') AND coalesce(regexp_matches(lag(ch) OVER w, '\s'), true) THEN 1 ELSE 0 END AS starts FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS word_ix FROM s)
SELECT doc_id, CAST(word_ix AS BIGINT) AS word_ix, string_agg(ch, '' ORDER BY i) AS text, min(i) * 6.0::DOUBLE AS x0, max(i) * 6.0::DOUBLE + 6 AS x1 FROM k WHERE NOT regexp_matches(ch, '\s') GROUP BY doc_id, word_ix""",
    "region_segments": """
WITH b AS (SELECT c_nationkey AS doc_id, c_custkey % 40 AS page, c_custkey AS k, c_custkey * 13 % 50 AS x FROM customer),
p AS (SELECT r.doc_id, r.page, r.k AS region_id, s.k AS segment_id, greatest(0, least(s.x + 20, r.x + 27) - greatest(s.x, r.x + 7)) * greatest(0, 10 - abs(s.x - r.x) * 3) / 200.0 AS share FROM b s JOIN b r USING (doc_id, page))
SELECT doc_id, page, region_id, segment_id FROM p WHERE share >= 0.2 QUALIFY row_number() OVER (PARTITION BY doc_id, page, region_id ORDER BY share DESC, segment_id DESC) = 1""",
    "lexical_topk": _TOP,
    "indexed_topk": _TOP,
    "lexical_prefix_topk": f"WITH {_bm25(8, prefix=True)} SELECT q AS query_id, c AS chunk_id, s AS bm25, r AS rank, round(score, 6) AS score FROM lexical",
    "vector_topk": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND len(a.e) = len(b.e))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s WHERE score > -1 QUALIFY rank < 8""",
    "hybrid_fusion": f"WITH {_FUSED} SELECT q AS query_id, c AS chunk_id, score, vector_score, rank FROM fused",
    "gated_passages": rf"""WITH {_FUSED},
told AS (SELECT f.*, d.text, {_OVERLAP} AS o FROM (SELECT f.*, {_TERMS.format("b.text")} AS ts FROM fused f JOIN benchmark b ON b.item_id = f.q) f JOIN (SELECT doc_id, text, lower(text) AS low, regexp_split_to_array(lower(text), '\W+') AS ws FROM documents) d ON d.doc_id = f.c),
gate AS (SELECT q, CASE WHEN max(o) >= 0.34 THEN 'lexical' WHEN coalesce(max(vector_score), 0) >= 0.45 THEN 'vector' END AS reason FROM told GROUP BY q),
passed AS (SELECT told.*, reason FROM told JOIN gate USING (q) WHERE reason IS NOT NULL)
SELECT b.item_id AS query_id, coalesce(rank, -1) AS rank, coalesce(c, -1) AS chunk_id, md5(coalesce(p.text, '')) AS digest, coalesce(score, -1) AS score, coalesce(vector_score, -1) AS vector_score, round(coalesce(o, -1), 6) AS overlap,
  coalesce(reason, 'none') AS reason, CASE WHEN p.q IS NULL THEN 'no-match' ELSE 'hybrid' END AS mode FROM benchmark b LEFT JOIN passed p ON p.q = b.item_id""",
    "relevance_gate": rf"""WITH {_bm25(3)},
told AS (SELECT l.q, {_TERMS.format("b.text")} AS ts, lower(d.text) AS low, regexp_split_to_array(lower(d.text), '\W+') AS ws FROM lexical l JOIN benchmark b ON b.item_id = l.q JOIN documents d ON d.doc_id = l.c),
each AS (SELECT q, {_OVERLAP} AS o FROM told),
best AS (SELECT b.item_id AS query_id, coalesce(max(o), 0) AS o FROM benchmark b LEFT JOIN each ON each.q = b.item_id GROUP BY 1)
SELECT query_id, o >= 0.34 AS relevant, CASE WHEN o >= 0.34 THEN 'lexical' ELSE 'none' END AS reason, round(o, 6) AS best_lexical_overlap FROM best""",
    "conversation_stats": f"""WITH {_CARDS}
SELECT c.conv_id AS doc_id, (SELECT count(*) FROM pairs p WHERE p.doc_id = c.conv_id) AS block_count, 0::BIGINT AS chunk_count, (SELECT count(*) FROM cards k WHERE k.doc_id = c.conv_id) AS flash_card_count, 0::BIGINT AS mcq_count, 0::BIGINT AS game_count, 0::BIGINT AS embedded_chunk_count
FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    "merged_blocks": rf"""WITH {_QA}, clean AS (SELECT doc_id, turn, {_TRIM.format("q")} AS q, {_TRIM.format("a")} AS a FROM pairs),
many AS (SELECT conv_id // 4 AS m FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1 HAVING count(*) > 1),
made AS (SELECT doc_id // 4 AS m, doc_id % 4 AS s, turn, 'm' || (doc_id % 4) || '_b' || turn AS block_id, concat_ws(chr(10) || chr(10), CASE WHEN q <> '' THEN '**Q:** ' || q END, CASE WHEN a <> '' THEN '**A:** ' || a END) AS content FROM clean)
SELECT m AS doc_id, row_number() OVER (PARTITION BY m ORDER BY s, turn, block_id) - 1 AS ord, block_id, md5(content) AS digest FROM made JOIN many USING (m)""",
    "event_counts": "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
} | files.SQL | parts.SQL
SQL["next_block_numbers"] = f"WITH {_BLOCKS} SELECT doc_id, 0::BIGINT AS page, count(*) AS next FROM blocks GROUP BY doc_id"
