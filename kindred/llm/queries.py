"""The ten operators applied to whole tables: one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from kindred.llm import byte_bpe, chat, decontaminate, importance, jaccard_join, lattice, quality_rules, token_files, toxicity, warc
from kindred.llm.runtime import fresh, table, written


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_windows", "item_windows", "coverage", "reparameterised")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the token files."""
    folder = fresh(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its worst sentence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model, carry=["doc_id"])
    return out.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id"), 4).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").alias("n_offending"),
        F.col("worst.start").alias("worst_start"),
        F.col("worst.end").alias("worst_end"),
        F.col("worst.score").alias("worst_score"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), carry=["doc_id"], offsets=False, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document against those labelled good, and whether it is in the sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.resample(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", "log_weight", "tempered_weight", "noisy_weight", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the bundles."""
    folder = fresh(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_warc(spark, folder)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy class and number of links of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs).select("doc_id", "class_id", "n_links")


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the lattice model, and under two models of whole words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~toxicity.held_out(F.col("doc_id"), 7)).alias("train"))
    out = lattice.score(docs, public_tokenizers.path("piece_bpe_32k.model"), "train")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "urn_score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the verdict of rules and hosts, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = quality_rules.quality_rules(docs)
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "host_rejected", "kept")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted segments; -7 has texts that imitate marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    imitation = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", imitation), (-7, 1, "assistant", imitation)], turns.schema)
    return chat.digests(written(chat.format_chat(turns.unionByName(more)), "chat"))


def queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    named = [op1_decontamination, op2_token_files, op3_toxicity, op4_byte_bpe, op5_importance, op6_warc, op7_jaccard_join, op8_lattice, op9_quality_rules, op10_chat]
    return {f.__name__: f for f in named}
