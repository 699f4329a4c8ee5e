"""Documents to tokens for training, in five stages.

language: documents without a letter go, and those that do not fit the language found: of their
  trigrams less than ``LEAST_FAMILIAR`` are known in it. Text of a language not learned or of no
  language goes so; one in several learned languages stays. The others get the language that was found.
lines: later copies of runs of lines of 50 words are cut out of the texts. A document of which
  nothing is left goes.
near copies: one document of each group linked by n-gram similarity stays.
mix: sources are mixed to their target weights, by quotas of their shards. A document the mix takes twice
  is there twice, one it does not take is not. One document of a shard is cut at most, the one in which its
  quota ends; the words taken of it, its first ones, are there. A source has a shard for each million words.
tokens: the ids of each text. A text the ids do not decode to stays and says so in ``exact``; none
  should, as the vocabulary has all bytes.

All but the last stage return the columns of the documents they get, which are written as
Parquet and read again for the next; what the next has read is removed. Null and empty texts go in
the first stage. Columns beside those of documents pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, jaccard, language, lines, mixing
from tablewright.llm.common import fresh
from tablewright.sources.scratch import remove, scratch_path

#: Measured: documents 0.53 at least and 0.73 but for two of 10,000; text of languages not learned 0.40 at most.
LEAST_FAMILIAR = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, with the language that was found as ``lang``."""
    chain = language.fit(docs)
    boxed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    found = language.predict(boxed, chain).filter((F.col("lang_pred") != "und") & (F.col("familiar") >= LEAST_FAMILIAR))
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of runs of lines."""
    runs = fresh(docs, "runs")
    cut = lines.dedup_lines(docs, runs)
    left = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)) | (F.size(runs) == 0)
    kept = cut.filter(left)
    return kept.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs, from_first=True)
    whole = F.floor(F.coalesce(F.try_divide(F.col("taken"), F.col("size")), F.lit(0))).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    times = whole + F.when(part > 0, 1).otherwise(0)
    begin = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.lit(1), part), "")
    # first the whole text as often as it is taken whole, then the part
    copies = F.filter(F.transform(F.sequence(F.lit(1), times), lambda i: F.when(i > whole, begin).otherwise(F.col("text"))), lambda x: x.isNotNull())
    rows = mixed.filter("taken > 0").withColumn(fresh(mixed, "new_text"), F.explode(copies))
    text = rows.columns[-1]
    new = {"text": F.col(text), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return rows.select(*[new[c].alias(c) if c in new else c for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens and whether they decode to the text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), path, decoded="decoded")
    # add_columns keeps the text: the ids stand for it exactly if it comes back
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("language", identify), ("lines", cut_lines), ("near copies", keep_one), ("mix", mix), ("tokens", tokenize)]
#: A conditional random field and MinHash are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
