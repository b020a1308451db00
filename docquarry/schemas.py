"""Fixed schemas; nothing in this package infers a schema from data."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

COLLECTION = T.StructType([
    T.StructField("collection_name", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("document", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("page_url", T.StringType()),
    T.StructField("chunk_pos", T.IntegerType()),
])

PROJECTS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("collection_name", T.StringType()),
    T.StructField("store_path", T.StringType()),
    T.StructField("embedding_provider", T.StringType()),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("collection_name", T.StringType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("query_embedding", T.ArrayType(T.FloatType())),
    T.StructField("top_k", T.IntegerType()),
])

NEIGHBOURS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("collection_name", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("distance", T.DoubleType()),
])

VECTORS = T.StructType([
    T.StructField("content_key", T.BinaryType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

MANIFEST = T.StructType([
    T.StructField("collection_name", T.StringType()),
    T.StructField("write", T.StringType()),
    T.StructField("of", T.LongType()),
    T.StructField("records", T.LongType()),
    T.StructField("shortest", T.IntegerType()),
    T.StructField("longest", T.IntegerType()),
    T.StructField("provider_name", T.StringType()),
    T.StructField("provider_model", T.StringType()),
    T.StructField("provider_batch_size", T.IntegerType()),
])
