"""The operators applied to the whole tables, each with the SQL that says the same if SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import alignment, bpe, jaccard, language, licenses, lines, mixing, near_vectors, packing, prefix_trie, quality, search, secrets
from tablewright.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_licenses")
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every text."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                        F.to_json("detections").alias("detections"))


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that are not held out."""
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "familiar")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from labelled rows that are not held out."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op6_mixing", mixing.SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of 150 % of all words takes."""
    return mixing.mix(table(spark, sf_dir, "documents"), keep=[]).drop("source")


@query("op2_secrets", secrets.SQL)
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@query("op8_jaccard", jaccard.SQL)
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between near copies among all documents, and each document's class."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_lines", lines.SQL)
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier in the documents, and the texts without them."""
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op3_near_vectors", near_vectors.SQL)
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between embeddings of one label, and each one's component."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_search")
def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of each one whose vec_id is divisible by 20."""
    return search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4,096 ids and the sequences they are packed into."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], ids=False)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies lie over each other in every text."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents"), *paths, keep=["doc_id"], with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


@query("op12_prefix_trie", prefix_trie.SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
