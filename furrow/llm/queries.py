"""The thin queries over the whole tables that apply each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, hilbert_ann, mixing, quality_pu, quality_rules, secrets, simhash, token_counts, toxicity, warc
from furrow.llm.oracles import ORACLES as ORACLES


def tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get 8 MB of a table at a time: memory follows the longest text, not the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the features, base_failed and kept of every document."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of every vector whose id is divisible by 20."""
    bounded_batches(spark)
    return hilbert_ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    bounded_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts.n_tokens("text", tokenizer("piece_bpe_32k.model")).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the secret scan: doc_id, place, score and verdict, with a digest for the candidate."""
    trees = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(_table(spark, sf_dir, "documents"), trees)
    return found.withColumn("candidate_sha256", F.sha2("candidate", 256)).drop("candidate")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the chain's probabilities and whether the document is toxic.

    The labels mark one toxicity category; the chain's first link is the other labelled trait, junk
    text, whose probability the toxicity model sees.
    """
    bounded_batches(spark)
    labels = _table(spark, sf_dir, "labels").withColumn("junk", 1 - F.col("quality"))
    found = toxicity.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels, ["junk", "toxic"])
    return found.select("doc_id", "p_junk", "p_toxic", F.col("is_toxic").alias("toxic"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    bounded_batches(spark)
    found = quality_pu.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    bounded_batches(spark)
    path = tokenizer("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", bpe.round_trip("text", path).alias("b"))
    return coded.select(
        "doc_id",
        F.size("b.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("b.ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("b.decoded", 256).alias("decoded_sha256"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and the position of the first word of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read back from the archives."""
    bounded_batches(spark)
    manifest, folder = warc.archive_pages(_table(spark, sf_dir, "pages"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = warc.warc_records(manifest.repartition(tasks), folder)
    return found.select(
        F.col("source").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_source").cast("long").alias("refers_to"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint in hex and component_id of every document."""
    bounded_batches(spark)
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=3)
    return found.select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_nearest": op2_nearest,
    "op3_token_counts": op3_token_counts,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
}
