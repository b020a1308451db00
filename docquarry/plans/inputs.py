"""Inputs of the registered queries: the given tables, and tables Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import urls
from docquarry.functions.html import visible_text
from docquarry.operators.chunks import number_chunks, prepare_pages, to_records
from docquarry.operators.embedding import Provider, embed
from docquarry.session import release, scope, scratch_path, spread, stage, stage_keyed
from docquarry.sources.pages import scan_pages
from docquarry.sources.store import CollectionStore

FAN_OUT = 16
SITES = 4


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pages(spark, f"{sf_dir}/pages.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def host(url: str = "url") -> Column:
    return urls.netloc(F.col(url))


def bare_host(name: Column) -> Column:
    """Host without a first label that only names a variant of the site."""
    return F.regexp_replace(name, r"^(?:www|m|blog)\.", "")


def all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page address and every link target, with the base address of the site."""
    from docquarry.operators.links import extract_links, resolve_links

    stored = pages(spark, sf_dir)
    own = stored.select("url", F.lit(-1).alias("pos"), F.col("url").alias("link_url"))
    linked = resolve_links(extract_links(stored)).select(
        F.col("src_url").alias("url"), "pos", "link_url"
    )
    base = F.concat(F.lit("https://"), bare_host(host()))
    return own.unionByName(linked).withColumn("base", base)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry row per host of ``pages``."""
    name = F.col("name")
    base = F.concat(F.lit("https://"), name)
    return (
        pages(spark, sf_dir).select(host().alias("name")).distinct()
        .select(
            "name", base.alias("url"), urls.collection_name(base).alias("collection_name"),
            F.concat(F.lit("store/collection_name="), urls.collection_name(base)).alias("store_path"),
            F.when(name.startswith("blog."), "hashed").alias("embedding_provider"),
        )
    )


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four linked sites ``(project, i, url, html)``, made from ``pages``.

    Page ``i`` of a site keeps its own links and gains links to ``16i+1 .. 16i+16``,
    ``3i+1``, ``i-1``, the start page and one foreign host. A page whose HTML breaks off
    before the end of the body counts as not fetched: its ``html`` is NULL. Start pages are always fetched.
    """
    own_path = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    own_query = F.regexp_extract("url", r"\?([^#]*)", 1)
    project = F.col("page_id") % SITES
    made = pages(spark, sf_dir).select(
        project.alias("project"),
        F.floor(F.col("page_id") / SITES).alias("i"),
        F.concat(
            F.lit("https://docs"), project.cast("string"), F.lit(".example.com"), own_path,
            F.lit("/p"), F.col("page_id").cast("string"),
            F.when(own_query != "", F.concat(F.lit("?"), own_query)).otherwise(F.lit("")),
        ).alias("url"),
        "html",
    )
    i = F.col("i")
    children = F.transform(
        F.sequence(F.lit(1), F.lit(FAN_OUT)), lambda n: i * FAN_OUT + n
    )
    others = F.array(i * 3 + 1, F.greatest(i - 1, F.lit(0)), F.lit(0).cast("bigint"))
    wanted = made.select("project", "i", F.posexplode(F.concat(children, others)).alias("pos", "j"))
    addresses = made.select("project", F.col("i").alias("j"), F.col("url").alias("target"))
    anchor = F.concat(
        F.lit('<a href="'), F.replace("target", F.lit("&"), F.lit("&amp;")), F.lit('">'),
        F.col("j").cast("string"), F.lit("</a> "),
    )
    anchors = (
        wanted.join(addresses, ["project", "j"])
        .groupBy("project", "i")
        .agg(F.array_sort(F.collect_list(F.struct("pos", anchor.alias("a")))).alias("links"))
        .select("project", "i", F.array_join(F.col("links.a"), "").alias("links"))
    )
    foreign = F.concat(F.lit('<a href="https://off.example.org/'), i.cast("string"), F.lit('">x</a>'))
    site = made.join(anchors, ["project", "i"]).select(
        "project", "i", "url",
        F.when(
            F.col("html").contains("</body>") | (i == 0),
            F.concat("html", F.lit("<nav>"), "links", foreign, F.lit("</nav>")),
        ).alias("html"),
    )
    return spread(stage(site, "site"))


def site_projects(site: DataFrame) -> DataFrame:
    """The start page of each site as ``(project, base_url)``."""
    return site.where("i = 0").select("project", F.col("url").alias("base_url"))


def document_pages(spark: SparkSession, sf_dir: str, by_source: bool = True) -> DataFrame:
    """``documents`` as pages of one site per source, or of a single site."""
    name = F.col("source") if by_source else F.lit("corpus")
    base = F.concat(F.lit("https://"), name, F.lit(".example.com/docs"))
    return prepare_pages(
        table(spark, sf_dir, "documents").select(
            name.alias("project"), base.alias("base_url"),
            F.concat(base, F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
            F.col("doc_id").alias("page_rank"), "text",
        )
    )


def numbered_documents(spark: SparkSession, sf_dir: str, by_source: bool = True) -> DataFrame:
    prepared = stage_keyed(document_pages(spark, sf_dir, by_source), "prepared", "project", "page_rank")
    return number_chunks(prepared, keys=("project", "page_rank"))


def document_store(spark: SparkSession, sf_dir: str) -> CollectionStore:
    """A store with the chunks of all ``documents`` in one collection."""
    store = CollectionStore(spark, scratch_path(spark, "store"))
    with scope(spark):
        chunks = numbered_documents(spark, sf_dir, by_source=False)
        release(spark)
        store.write(to_records(embed(chunks, Provider())))
    del chunks
    release(spark)
    return store


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as collection records, one collection per label."""
    base = F.concat(F.lit("https://label"), F.col("label").cast("string"), F.lit(".example.com"))
    number = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        urls.collection_name(base).alias("collection_name"),
        number.alias("id"),
        F.concat(F.lit("vector "), number).alias("document"),
        "embedding",
        F.create_map(F.lit("source"), base).alias("metadata"),
        F.concat(base, F.lit("/"), number).alias("page_url"),
        F.lit(0).alias("chunk_pos"),
    )


def corpus_name() -> Column:
    return urls.collection_name(F.lit("https://corpus.example.com/docs"))


def text_queries(spark: SparkSession, sf_dir: str, top_k: int) -> DataFrame:
    """Every text of ``benchmark`` as a query on the collection of all documents."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), corpus_name().alias("collection_name"),
        F.col("text").alias("query_text"),
        F.lit(None).cast("array<float>").alias("query_embedding"),
        F.lit(top_k).alias("top_k"),
    )


def mixed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, vectors, vectors cut to three numbers, and documents whose text is withheld."""
    none_text = F.lit(None).cast("string")
    none_vector = F.lit(None).cast("array<float>")

    kinds = ["text", "vector", "short", "document"]

    def shape(df, kind, number, text, vector):
        return df.select(
            F.lit(kind).alias("kind"),
            (F.col(number) * len(kinds) + kinds.index(kind)).alias("query_id"),
            text.alias("query_text"), vector.alias("query_embedding"),
        )

    vectors = table(spark, sf_dir, "embeddings")
    withheld = F.when(F.col("lang") == "en", F.col("text"))
    return (
        shape(table(spark, sf_dir, "benchmark"), "text", "item_id", F.col("text"), none_vector)
        .unionByName(shape(vectors, "vector", "vec_id", none_text, F.col("embedding")))
        .unionByName(shape(vectors, "short", "vec_id", none_text, F.slice("embedding", 1, 3)))
        .unionByName(
            shape(table(spark, sf_dir, "documents"), "document", "doc_id", withheld, none_vector)
        )
    )


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible text of every page."""
    return prepare_pages(
        pages(spark, sf_dir).select(
            host().alias("project"), "url", F.col("page_id").alias("page_rank"),
            visible_text(F.col("html")).alias("text"),
        )
    )
