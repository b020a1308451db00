"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import urls
from docquarry.functions.html import visible_text
from docquarry.functions.text import chunk_text, clean_text
from docquarry.functions.vectors import HASH_DIMENSION
from docquarry.operators import cells, chunks, crawl, embedding, knn, links, registry
from docquarry.operators.embedding import Provider
from docquarry.plans import inputs
from docquarry.plans.jobs import index_and_search as run_index_and_search
from docquarry.plans.jobs import index_documentation as run_index
from docquarry.plans.jobs import search_docs as run_search
from docquarry.session import scratch_path, stage
from docquarry.sources.projects import find_projects, read_projects
from docquarry.sources.projects import write_projects as save_projects
from docquarry.sources.store import CollectionStore
from docquarry.sources.vectors import VectorCache


def _numbers(df: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "value"))


def _new_store(spark) -> CollectionStore:
    return CollectionStore(spark, scratch_path(spark, "store"))


def _vector_store(spark, sf_dir) -> CollectionStore:
    store = _new_store(spark)
    store.write(inputs.vector_records(spark, sf_dir))
    return store


# Sources and sinks


def scan_pages(spark, sf_dir):
    return inputs.pages(spark, sf_dir)


def scan_projects(spark, sf_dir):
    path = scratch_path(spark, "projects")
    save_projects(inputs.projects(spark, sf_dir), path)
    wanted = inputs.pages(spark, sf_dir).select(
        inputs.bare_host(inputs.host()).alias("name")
    ).distinct()
    return find_projects(read_projects(spark, path), wanted)


def write_projects(spark, sf_dir):
    path = scratch_path(spark, "projects")
    save_projects(inputs.projects(spark, sf_dir), path)
    return read_projects(spark, path)


def write_collection(spark, sf_dir):
    return _vector_store(spark, sf_dir).scan().select(
        "collection_name", "id", "document", F.col("metadata")["source"].alias("source"),
        "page_url", "chunk_pos", F.size("embedding").alias("dimension"),
    )


def scan_collection(spark, sf_dir):
    return _numbers(_vector_store(spark, sf_dir).scan(), "collection_name", "id")


def open_collection(spark, sf_dir):
    store = _vector_store(spark, sf_dir)
    name = store.first().first()["collection_name"]
    return store.open(name).unionByName(store.open("missing")).select("collection_name", "id")


def pick_collection(spark, sf_dir):
    return _vector_store(spark, sf_dir).first()


# URL predicates and projections


def _url_column(spark, sf_dir, **columns):
    return inputs.all_urls(spark, sf_dir).select(
        "url", "pos", *[column.alias(name) for name, column in columns.items()]
    )


def url_parts(spark, sf_dir):
    return inputs.all_urls(spark, sf_dir).select(
        "url", "pos", urls.parts(F.col("link_url")).alias("p")
    ).select("url", "pos", "p.*")


def url_normalize(spark, sf_dir):
    return _url_column(spark, sf_dir, normalized=urls.normalize(F.col("link_url")))


def same_domain(spark, sf_dir):
    normal = urls.normalize(F.col("link_url"))
    return _url_column(spark, sf_dir, same=urls.same_domain(normal, urls.netloc(F.col("base"))))


def allowed_host(spark, sf_dir):
    return _url_column(
        spark, sf_dir, allowed=urls.allowed_host(F.col("link_url"), F.col("base"))
    )


def non_root_path(spark, sf_dir):
    return _url_column(spark, sf_dir, deep=urls.non_root_path(F.col("link_url")))


def asset_block(spark, sf_dir):
    return _url_column(spark, sf_dir, asset=urls.is_asset(F.col("link_url")))


def keyword_block(spark, sf_dir):
    return _url_column(spark, sf_dir, blocked=urls.has_blocked_keyword(F.col("link_url")))


def relevant_docs_url(spark, sf_dir):
    return _url_column(
        spark, sf_dir, relevant=urls.relevant_docs_url(F.col("link_url"), F.col("base"))
    )


def project_url_lint(spark, sf_dir):
    return registry.lint_projects(
        inputs.pages(spark, sf_dir).select(inputs.host().alias("name"), "url")
    )


def collection_name(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select(
        "page_id", urls.collection_name(F.col("url")).alias("collection_name")
    )


# Links and crawl


def extract_links(spark, sf_dir):
    return links.extract_links(inputs.pages(spark, sf_dir)).drop("base_url")


def resolve_links(spark, sf_dir):
    return links.resolve_links(links.extract_links(inputs.pages(spark, sf_dir)))


def link_audit(spark, sf_dir):
    audit = links.link_audit(inputs.pages(spark, sf_dir))
    return audit.withColumn(
        "passed_examples", F.array_join("passed_examples", " ")
    ).withColumn("filtered_examples", F.array_join("filtered_examples", " "))


def link_graph(spark, sf_dir):
    bases = inputs.projects(spark, sf_dir).select(
        F.col("name").alias("project"), F.col("url").alias("base_url")
    )
    return links.link_graph(bases, links.page_links(inputs.pages(spark, sf_dir)))


def _walk(spark, sf_dir, **limits):
    site = inputs.site_pages(spark, sf_dir)
    fetched = site.where("html is not null")
    return crawl.crawl(
        inputs.site_projects(site), links.page_links(fetched), fetched.select("url"), **limits
    )


def crawl_bfs(spark, sf_dir):
    return _walk(spark, sf_dir).pages()


def visited_dedup(spark, sf_dir):
    site = inputs.site_pages(spark, sf_dir)
    edges = links.page_links(site.where("html is not null")).join(
        site.select(F.col("url").alias("src_url"), "project", "i"), "src_url"
    )
    return crawl.first_discovery(edges, ["project"], "i")


def depth_limit(spark, sf_dir):
    return _walk(spark, sf_dir, max_depth=1).queue.select(
        "project", "url", "depth", "queue_rank", "status"
    )


def page_limit(spark, sf_dir):
    return _walk(spark, sf_dir, max_pages=12, max_depth=5).queue.select(
        "project", "url", "depth", "queue_rank", "page_rank", "status"
    )


def fetch_status(spark, sf_dir):
    site = inputs.site_pages(spark, sf_dir)
    fetched = site.where("html is not null")
    targets = links.page_links(fetched).select(F.col("dst_url").alias("url"))
    return crawl.fetch_status(targets, fetched)


def crawl_summary(spark, sf_dir):
    return _walk(spark, sf_dir).summary()


def scrape_report(spark, sf_dir):
    walk = _walk(spark, sf_dir)
    site = inputs.site_pages(spark, sf_dir).select("url", "html")
    text = walk.pages().join(site, "url").withColumn("text", visible_text(F.col("html")))
    return crawl.scrape_report(text)


# Text


def visible_text_query(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select(
        "page_id", visible_text(F.col("html")).alias("text")
    )


def clean_text_query(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", clean_text(F.col("text")).alias("text")
    )


def chunk_words(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk_pos", "document")
    )


def drop_empty(spark, sf_dir):
    return chunks.chunk_pages(inputs.text_pages(spark, sf_dir)).select(
        F.col("page_rank").alias("page_id"), "chunk_pos", "document"
    )


def flatten_chunks(spark, sf_dir):
    return chunks.chunk_pages(inputs.document_pages(spark, sf_dir).drop("base_url"))


def chunk_ids(spark, sf_dir):
    return inputs.numbered_documents(spark, sf_dir).select(
        "project", "page_rank", "chunk_pos", "id"
    )


def chunk_metadata(spark, sf_dir):
    numbered = inputs.numbered_documents(spark, sf_dir)
    placed = numbered.withColumn("embedding", F.lit(None).cast("array<float>"))
    return chunks.to_records(placed).select(
        "collection_name", "id", F.col("metadata")["source"].alias("source"), "page_url",
        "chunk_pos",
    )


def empty_corpus(spark, sf_dir):
    hosts = inputs.projects(spark, sf_dir).select(F.col("name").alias("project"))
    return chunks.corpus_status(hosts, inputs.text_pages(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    text = inputs.pages(spark, sf_dir).select(
        inputs.host().alias("host"), "html", visible_text(F.col("html")).alias("text")
    )
    return chunks.corpus_stats(text, "host")


# Embedding


def _document_chunks(spark, sf_dir):
    return chunks.chunk_pages(inputs.document_pages(spark, sf_dir)).select(
        F.col("page_rank").alias("doc_id"), "chunk_pos", "document"
    )


def embed_texts(spark, sf_dir):
    vectors = embedding.embed(_document_chunks(spark, sf_dir), Provider())
    return _numbers(vectors, "doc_id", "chunk_pos")


def _calls(spark, sf_dir, size):
    """Chunks of all documents with the vector of a function that tells the place of a text in its call, and the call's size."""
    def places(texts):
        return [[float(place), float(len(texts))] for place in range(len(texts))]

    provider = Provider("places", "position-size", 2, batch_size=size, function=places)
    numbered = inputs.numbered_documents(spark, sf_dir)
    return embedding.embed_in_order(numbered, ["project"], F.col("id").cast("bigint"), provider)


def embed_batches(spark, sf_dir):
    """The calls as sent; a text that was sent in another call than its number says would change them."""
    number = F.col("id").cast("bigint")
    return _calls(spark, sf_dir, embedding.BATCH_SIZE).groupBy("project", "batch_no").agg(
        F.max(F.col("embedding")[1]).cast("bigint").alias("texts"),
        F.min(number).alias("first_text"), F.max(number).alias("last_text"))


def embed_batch_calls(spark, sf_dir):
    """Place and size of the call of every text, with calls of 32."""
    return _calls(spark, sf_dir, 32).select(
        "project", F.col("id").cast("bigint").alias("number"), "batch_no",
        F.col("embedding")[0].cast("int").alias("batch_pos"), F.col("embedding")[1].cast("int").alias("batch_texts"))


def _sizes_provider(**options) -> Provider:
    """A user function: characters and words of each text."""

    def sizes(texts):
        return [[float(len(text)), float(len(text.split()))] for text in texts]

    return Provider("sizes", "characters-words", 2, function=sizes, **options)


def embed_batch_size(spark, sf_dir):
    provider = _sizes_provider().with_batch_size(32)
    vectors = embedding.embed(_document_chunks(spark, sf_dir), provider)
    return _numbers(vectors, "doc_id", "chunk_pos")


def embed_cached(spark, sf_dir):
    """Chunks of labelled documents are embedded first, those of all documents in a second run: which run made the vector a chunk gets."""
    def run(number):
        return Provider("runs", "run-characters", 2, function=lambda texts: [[float(number), float(len(t))] for t in texts])

    every = stage(_document_chunks(spark, sf_dir), "chunks")
    labelled = inputs.table(spark, sf_dir, "labels").select("doc_id")
    cache = VectorCache(spark, scratch_path(spark, "vectors"))
    cache.embed(every.join(labelled, "doc_id", "left_semi"), run(1))
    return cache.embed(every, run(2)).select(
        "doc_id", "chunk_pos", F.col("embedding")[0].cast("int").alias("made_in"), F.col("embedding")[1].cast("int").alias("characters"))


def embed_retry(spark, sf_dir):
    steady = _sizes_provider().function

    def flaky():
        state = {"calls": 0}

        def function(texts):
            state["calls"] += 1
            if state["calls"] % 2:
                raise ConnectionError("try again")
            return steady(texts)

        return function

    provider = Provider(
        "flaky", "characters-words", 2, function=flaky(), sleep=lambda seconds: None
    )
    vectors = embedding.embed(_document_chunks(spark, sf_dir), provider)
    return _numbers(vectors, "doc_id", "chunk_pos")


def embed_validate(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    vectors = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    shortened = F.when(F.col("lang") == "fr", F.slice("embedding", 1, 3)).otherwise(
        F.col("embedding")
    )
    joined = documents.join(vectors, "doc_id", "left").withColumn("embedding", shortened)
    return embedding.validate_embeddings(joined, "source", HASH_DIMENSION)


def provider_info(spark, sf_dir):
    store = _new_store(spark)
    records = inputs.vector_records(spark, sf_dir)
    names = records.select("collection_name").distinct()
    store.write(records, embedding.provider_info(names, Provider()))
    return store.contracts().drop("shortest", "longest")


def provider_mismatch(spark, sf_dir):
    """Texts asked of collections of two providers with the built-in one; those of the other refuse them."""
    store = _new_store(spark)
    records = inputs.vector_records(spark, sf_dir).withColumn("label", F.regexp_extract("page_url", r"label(\d+)", 1).cast("int"))
    chosen = records.select("collection_name", F.when(F.col("label") % 2 == 0, "hashed").otherwise("own").alias("choice")).distinct()
    providers = {"hashed": Provider(), "own": _sizes_provider()}
    made_with = [c.alias(name) for name, c in embedding.described(F.col("choice"), providers).items()]
    store.write(records, chosen.select("collection_name", *made_with))
    label = (F.col("query_id") % 10).cast("string")
    queries = inputs.text_queries(spark, sf_dir, 2).withColumn(
        "collection_name", urls.collection_name(F.concat(F.lit("https://label"), label, F.lit(".example.com"))))
    found = run_search(queries, store.scan_for(queries), contracts=store.contracts())
    return found.groupBy("query_id", "error").agg(F.count("id").alias("results"))


def embed_queries(spark, sf_dir):
    vectors = embedding.embed(
        inputs.text_queries(spark, sf_dir, 5), Provider(), "query_text", "vector"
    )
    return _numbers(vectors, "query_id", vector="vector")


def embed_input_check(spark, sf_dir):
    text = F.when(F.col("lang") == "en", F.col("text"))
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    embedding.require_text_column(documents, "text")
    return documents.select("doc_id", embedding.input_error(F.col("text")).alias("error"))


def attach_embeddings(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "source")
    vectors = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    attached = embedding.attach_embeddings(documents, vectors, ["doc_id"])
    return attached.select(
        "doc_id", "source", "error", F.col("embedding")[0].alias("first_number"),
        F.element_at("embedding", -1).alias("last_number"),
    )


# Vector collection


def _plain_documents(spark, sf_dir):
    """``documents`` as records without vectors, one collection per source."""
    base = F.concat(F.lit("https://"), "source", F.lit(".example.com/docs"))
    return inputs.table(spark, sf_dir, "documents").select(
        urls.collection_name(base).alias("collection_name"),
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.create_map(F.lit("source"), base).alias("metadata"),
        F.concat(base, F.lit("/"), F.col("doc_id").cast("string")).alias("page_url"),
        F.lit(0).alias("chunk_pos"),
    )


def collection_add(spark, sf_dir):
    """Labelled documents come first, with another text; then all documents are added."""
    records = _plain_documents(spark, sf_dir)
    labelled = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    store = _new_store(spark)
    store.write(
        records.join(labelled, "id", "left_semi").withColumn("document", F.lit("labelled"))
    )
    store.add(records)
    return store.scan().select("collection_name", "id", "document")


def collection_delete(spark, sf_dir):
    """All documents but those labelled toxic, which are deleted from the stored collections."""
    records = _plain_documents(spark, sf_dir)
    store = _new_store(spark)
    store.write(records)
    toxic = inputs.table(spark, sf_dir, "labels").where("toxic = 1").select(
        F.col("doc_id").cast("string").alias("id")
    )
    ids = records.select("collection_name", "id").join(toxic, "id")
    store.delete(ids)
    return store.scan().select("collection_name", "id", "document")


def collection_clear(spark, sf_dir):
    store = _vector_store(spark, sf_dir)
    store.clear(store.first().first()["collection_name"])
    return store.counts()


def collection_count(spark, sf_dir):
    return _vector_store(spark, sf_dir).counts()


def collection_info(spark, sf_dir):
    labels = inputs.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("name")
    )
    sources = inputs.table(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    url = F.concat(F.lit("https://"), "name", F.lit(".example.com"))
    projects = labels.unionByName(sources).distinct().select(
        "name", url.alias("url"), urls.collection_name(url).alias("collection_name")
    )
    return _vector_store(spark, sf_dir).info(projects)


def knn_one(spark, sf_dir):
    vector = [HASH_DIMENSION ** -0.5] * HASH_DIMENSION
    return knn.knn(inputs.vector_records(spark, sf_dir), vector, 20)


def knn_batch(spark, sf_dir):
    everything = inputs.vector_records(spark, sf_dir).withColumn("collection_name", F.lit("all"))
    queries = everything.select(
        F.col("id").cast("bigint").alias("query_id"), "collection_name",
        F.col("embedding").alias("vector"), F.lit(5).alias("top_k"),
    )
    return knn.knn_batch(queries, everything).select("query_id", "rank", "id", "distance")


def knn_cells(spark, sf_dir):
    """Recall of the approximate search, all vectors as queries, against the exact one."""
    everything = inputs.vector_records(spark, sf_dir).withColumn("collection_name", F.lit("all"))
    queries = everything.select(
        F.col("id").cast("bigint").alias("query_id"), "collection_name",
        F.col("embedding").alias("vector"), F.lit(5).alias("top_k"),
    )
    path = scratch_path(spark, "cells")
    cells.write_cells(everything, path, cells=32)
    found = cells.recall(cells.search_cells(queries, path, probes=24), knn.knn_batch(queries, everything))
    return found.select("queries", (F.col("recall") >= 0.9).alias("recall_reached"))


def _answers(spark, sf_dir, top_k=5):
    queries = inputs.text_queries(spark, sf_dir, top_k)
    ready = knn.dispatch(queries, Provider(), HASH_DIMENSION)
    return knn.search(ready, inputs.document_store(spark, sf_dir).scan())


def _with_source(df):
    return df.withColumn("source", F.col("metadata")["source"]).drop("metadata")


def knn_projection(spark, sf_dir):
    return _with_source(_answers(spark, sf_dir)).select(
        "query_id", "rank", "document", "source", F.col("score").alias("distance")
    )


def results_raw(spark, sf_dir):
    raw = knn.results_raw(_answers(spark, sf_dir, 20))
    return raw.select(
        "query_id", F.array_join("ids", " ").alias("ids"),
        F.element_at("distances", 1).alias("nearest"),
        F.element_at("distances", -1).alias("farthest"),
        F.array_join("documents", "|").alias("documents"),
        F.element_at("metadatas", 1)["source"].alias("source"),
    )


def results_shaped(spark, sf_dir):
    return _with_source(knn.results_shaped(knn.results_raw(_answers(spark, sf_dir))))


def results_report(spark, sf_dir):
    return _with_source(knn.results_report(_answers(spark, sf_dir)))


def query_dispatch(spark, sf_dir):
    ready = knn.dispatch(inputs.mixed_queries(spark, sf_dir), Provider(), HASH_DIMENSION)
    return ready.select("kind", "query_id", F.size("vector").alias("dimension"), "error")


# Registry


def add_projects(spark, sf_dir):
    every = inputs.projects(spark, sf_dir)
    existing = every.where("embedding_provider is not null")
    offered = every.select("name", "url").unionByName(
        inputs.pages(spark, sf_dir).select(inputs.host().alias("name"), "url")
    )
    return registry.add_projects(existing, offered, "store")


def list_projects(spark, sf_dir):
    hosts = inputs.pages(spark, sf_dir).select(inputs.host().alias("host"))
    name = urls.collection_name(F.concat(F.lit("https://"), "host"))
    readable = ~F.col("host").startswith("blog.")
    stored = (
        hosts.where(~F.col("host").startswith("m."))
        .groupBy("host").count()
        .select(name.alias("collection_name"), F.when(readable, F.col("count")).alias("record_count"))
    )
    return registry.list_projects(inputs.projects(spark, sf_dir), stored)


def resolve_provider(spark, sf_dir):
    projects = inputs.projects(spark, sf_dir)
    plain = registry.resolve_provider(projects)
    shared = registry.resolve_provider(projects, "lookup").withColumnRenamed("provider", "shared")
    return plain.join(shared, "name")


# Whole jobs


def index_documentation(spark, sf_dir):
    site = inputs.site_pages(spark, sf_dir)
    store = _new_store(spark)
    run_index(inputs.site_projects(site), site, store)
    return _with_source(store.scan()).select(
        "collection_name", "id", "document", "page_url", "chunk_pos", "source"
    )


def search_docs(spark, sf_dir):
    queries = inputs.mixed_queries(spark, sf_dir).select(
        "query_id", inputs.corpus_name().alias("collection_name"),
        "query_text", "query_embedding", F.lit(5).alias("top_k"),
    )
    store = inputs.document_store(spark, sf_dir)
    found = run_search(queries, store.scan(), contracts=store.contracts())
    return found.select("query_id", "rank", "id", "score", "document", "error")


def index_and_search(spark, sf_dir):
    site = inputs.site_pages(spark, sf_dir)
    bases = inputs.site_projects(site)
    routed = inputs.text_queries(spark, sf_dir, 5).withColumn(
        "project", F.col("query_id") % inputs.SITES
    ).drop("collection_name")
    queries = routed.join(bases, "project").withColumn(
        "collection_name", urls.collection_name(F.col("base_url"))
    )
    found = run_index_and_search(bases, site, _new_store(spark), queries)
    return _with_source(knn.results_report(found))


QUERIES = {
    "scan_pages": scan_pages,
    "scan_projects": scan_projects,
    "scan_collection": scan_collection,
    "open_collection": open_collection,
    "pick_collection": pick_collection,
    "write_collection": write_collection,
    "write_projects": write_projects,
    "url_parts": url_parts,
    "url_normalize": url_normalize,
    "same_domain": same_domain,
    "allowed_host": allowed_host,
    "non_root_path": non_root_path,
    "asset_block": asset_block,
    "keyword_block": keyword_block,
    "relevant_docs_url": relevant_docs_url,
    "project_url_lint": project_url_lint,
    "collection_name": collection_name,
    "extract_links": extract_links,
    "resolve_links": resolve_links,
    "link_audit": link_audit,
    "link_graph": link_graph,
    "crawl_bfs": crawl_bfs,
    "visited_dedup": visited_dedup,
    "depth_limit": depth_limit,
    "page_limit": page_limit,
    "fetch_status": fetch_status,
    "crawl_summary": crawl_summary,
    "scrape_report": scrape_report,
    "visible_text": visible_text_query,
    "clean_text": clean_text_query,
    "chunk_words": chunk_words,
    "drop_empty": drop_empty,
    "flatten_chunks": flatten_chunks,
    "chunk_ids": chunk_ids,
    "chunk_metadata": chunk_metadata,
    "empty_corpus": empty_corpus,
    "corpus_stats": corpus_stats,
    "embed_texts": embed_texts,
    "embed_batches": embed_batches,
    "embed_batch_calls": embed_batch_calls,
    "embed_cached": embed_cached,
    "embed_retry": embed_retry,
    "embed_validate": embed_validate,
    "embed_batch_size": embed_batch_size,
    "provider_info": provider_info,
    "provider_mismatch": provider_mismatch,
    "embed_queries": embed_queries,
    "embed_input_check": embed_input_check,
    "attach_embeddings": attach_embeddings,
    "collection_add": collection_add,
    "knn": knn_one,
    "knn_batch": knn_batch,
    "knn_cells": knn_cells,
    "knn_projection": knn_projection,
    "collection_delete": collection_delete,
    "collection_clear": collection_clear,
    "collection_count": collection_count,
    "collection_info": collection_info,
    "results_raw": results_raw,
    "results_shaped": results_shaped,
    "results_report": results_report,
    "query_dispatch": query_dispatch,
    "add_projects": add_projects,
    "list_projects": list_projects,
    "resolve_provider": resolve_provider,
    "index_documentation": index_documentation,
    "search_docs": search_docs,
    "index_and_search": index_and_search,
}
