"""The registered query of every operator; ``LLM_ORACLE`` has the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import chat, decontam, jaccard, langid, merkle, pieces, quality, repeats, rules, tokencount, topk, urlrep, whiten
from docquarry.llm.common import read
from docquarry.llm.oracle import LLM_ORACLE


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents."""
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples of all conversations and of a planted one, as digests read back from them."""
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)],
        "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(chat.prefix_examples(turns.unionByName(planted)))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 400-byte strings that occur more than once."""
    kept = repeats.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and whether they decode to the text again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, decoded=True).select(
        "doc_id", "n_tokens", "token_ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of all documents."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the documents that are not held out."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, substitutions allowed."""
    return decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; labels of documents judge the pages that show them."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = urlrep.page_outcomes(pages, read(spark, sf_dir, "labels"))
    return urlrep.filter_urls(pages, outcomes)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are similar."""
    return jaccard.similar_groups(read(spark, sf_dir, "documents"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents by the rule cascade."""
    return rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and their proofs tried on rows of which some are tampered with."""
    docs = read(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    more = [F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(docs, carry={"tampered": F.when(hit, merkle.leaf_digest(*more))})
    tried = merkle.verified(rows.withColumn("tampered", F.coalesce("tampered", "leaf")), "tampered")
    return tried.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                        "folded_root", "verified")


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened principal components of all vectors."""
    return whiten.whiten(read(spark, sf_dir, "embeddings"))


LLM_QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_chat": op2_chat,
    "op3_repeats": op3_repeats,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_reputation": op9_url_reputation,
    "op10_jaccard": op10_jaccard,
    "op11_rules": op11_rules,
    "op12_merkle": op12_merkle,
    "op13_whiten": op13_whiten,
}

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]
