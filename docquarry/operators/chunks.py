"""Clean page text, cut it into chunks and number the chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import urls
from docquarry.functions.text import MAX_WORDS, clean_text, word_windows, words
from docquarry.operators.numbering import ordered_totals, running_totals


def prepare_pages(pages: DataFrame) -> DataFrame:
    """Clean ``text`` and add ``n_words``; other columns, such as ``base_url``, stay."""
    return pages.withColumn("text", clean_text(F.col("text"))).withColumn(
        "n_words", F.coalesce(F.size(words(F.col("text"))), F.lit(0))
    )


def chunk_count(n_words: Column, max_words: int = MAX_WORDS) -> Column:
    return F.ceil(n_words / F.lit(float(max_words))).cast("bigint")


def chunk_pages(prepared: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per chunk with ``chunk_pos`` and ``document``; blank text has none."""
    kept = [c for c in prepared.columns if c not in ("text", "n_words")]
    return prepared.select(
        *kept,
        F.posexplode(word_windows(words(F.col("text")), max_words)).alias("chunk_pos", "document"),
    )


def chunk_offsets(prepared: DataFrame, max_words: int = MAX_WORDS, span: int | None = None,
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """``_start``, the first chunk number of each page, from word counts alone: no text is read or moved.

    ``page_rank`` may be of any density, since pages are dealt by ranges of it; with ``span`` they are dealt by
    that many consecutive ranks, which suits dense ranks.
    """
    counts = prepared.select(
        "project", "page_rank", *keys, chunk_count(F.col("n_words"), max_words).alias("_chunks")
    ).where("_chunks > 0")
    values = {"_start": F.col("_chunks")}
    if span is None:
        return ordered_totals(counts, ["project"], ["page_rank"], values).drop("_chunks")
    return running_totals(counts, ["project"], ["page_rank"], values, span).drop("_chunks")


def number_chunks(prepared: DataFrame, max_words: int = MAX_WORDS, span: int | None = None,
                  keys: tuple[str, ...] | None = None) -> DataFrame:
    """Chunks with ``id``: a running number per project as a string, from "0", in page order.

    ``keys`` are the columns by which ``prepared`` lies hashed, if it is a ``KeyedTable``; its text then meets
    the numbers where it lies. Otherwise Spark chooses how project and rank meet them.
    """
    number = (F.col("_start") + F.col("chunk_pos")).cast("string")
    if keys is None:
        with_text = prepared.where("n_words > 0").join(
            chunk_offsets(prepared, max_words, span), ["project", "page_rank"])
        return chunk_pages(with_text, max_words).withColumn("id", number).drop("_start")
    # One row of numbers per key, so that the key alone is joined; projects that share a page find their own in it.
    starts = chunk_offsets(prepared, max_words, span, tuple(c for c in keys if c not in ("project", "page_rank"))).groupBy(*keys).agg(
        F.collect_list(F.struct("project", "page_rank", "_start")).alias("_starts"))
    own = F.filter("_starts", lambda s: (s["project"] == F.col("project")) & (s["page_rank"] == F.col("page_rank")))
    with_text = prepared.where("n_words > 0").join(starts.hint("shuffle_hash"), list(keys)).withColumn(
        "_start", F.get(own, F.lit(0))["_start"]).drop("_starts")
    return chunk_pages(with_text, max_words).withColumn("id", number).drop("_start")


def source_metadata(base_url: Column) -> Column:
    """``{"source": base_url}``: the address of the site, not of the page."""
    return F.create_map(F.lit("source"), base_url)


def to_records(chunks: DataFrame) -> DataFrame:
    """Numbered chunks with ``base_url`` and vectors as collection records."""
    return chunks.select(
        urls.collection_name(F.col("base_url")).alias("collection_name"),
        "id", "document", "embedding",
        source_metadata(F.col("base_url")).alias("metadata"),
        F.col("url").alias("page_url"), "chunk_pos",
    )


def corpus_status(projects: DataFrame, prepared: DataFrame,
                  max_words: int = MAX_WORDS) -> DataFrame:
    """Chunk count per project; a project without any chunk is ``no_content``."""
    counts = prepared.groupBy("project").agg(
        F.sum(chunk_count(F.col("n_words"), max_words)).alias("_chunks")
    )
    chunks = F.coalesce(F.col("_chunks"), F.lit(0).cast("bigint"))
    return projects.select("project").join(counts, "project", "left").select(
        "project", chunks.alias("chunk_count"),
        F.when(chunks > 0, "indexed").otherwise("no_content").alias("status"),
    )


def corpus_stats(pages: DataFrame, group: str) -> DataFrame:
    """Page count and HTML and text sizes per group; ``pages(group, html, text)``."""
    return pages.groupBy(group).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.length("html")).alias("html_chars"),
        F.sum(F.length("text")).alias("text_chars"),
        F.max(F.length("text")).alias("longest_text"),
    )
