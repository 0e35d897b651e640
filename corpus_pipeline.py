"""From raw documents to token ids: five stages, each an operator of the llm subpackage.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage works on all that its predecessor kept. Stages read doc_id, text, lang and
source and hand on any other columns, whatever their names; a text is read whole, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, mixing, quality_pu, secrets, simhash
from furrow.llm.queries import bounded_batches, tokenizer
from furrow.session import discard, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled quality classifier doesn't reject: a score of 0.3 or more.

    Null texts score as empty ones, repeated rows alike, null ids are no training rows. Without labels of
    good documents every document scores 0.5 and stays; an empty table gives no rows.
    """
    bounded_batches(spark)
    model = quality_pu.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_pu.score("text", model) >= 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each SimHash group.

    Documents link where the fingerprints of their three-word shingles differ in three bits or fewer, as in
    op10; all such links are found, over the anchors. Null and blank texts are one group. Of rows that repeat an id each group keeps its own, of those without an id
    one per text stays, and of wholly equal rows one; an empty table gives no rows.
    """
    bounded_batches(spark)
    return simhash.keep_one(docs, simhash.near_duplicates(docs, groups=True))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked.

    Null and empty texts stay as they are, null sources count as '', repeated rows are masked alike, and
    an empty table gives no rows.
    """
    trees = secrets.train(secrets.labelled_findings(spark))
    return _with_length(secrets.redact(docs, trees), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of the mix: a row per reading of a document, sorted by position.

    Null and blank texts hold nothing to read and go. Null sources are a source of their own, null ids
    sort as '', repeated rows are read one by one, and an empty table gives no rows.
    """
    return _with_length(mixing.training_rows(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text again.

    A row for each reading of the mix, so documents repeat as it repeats them; null texts have no ids,
    and an empty table gives no rows.
    """
    bounded_batches(spark)
    path = tokenizer("byte_bpe_50k.json")
    coded = docs.select("doc_id", "lang", "source", "text", bpe.round_trip("text", path).alias("b"))
    whole = F.col("b.decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("b.ids").cast("long").alias("n_tokens"), F.col("b.ids").alias("ids"), whole.alias("round_trip"))


def _with_length(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``df`` with n_chars, where the documents have it, that of the text as it is now."""
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mix", mix),
    ("bpe", encode),
]

#: The stages rest on fitted models, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next.

    A stage's folder goes once the next one is written; the result reads the last.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
