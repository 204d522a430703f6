"""A training-data pipeline over the documents table.

Good documents are kept, one of each group of near-duplicates stays, secrets are blanked out, the
sources are mixed by weight, and what is left is encoded. Each stage takes all rows that
the one before it returned. Rows with null, empty, repeated or very long texts pass through
the operators as their docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import byte_bpe, jaccard_join, mixing, quality_model, secret_scan
from touchline.llm.common import crc_remainder, free_name, table
from touchline.session import materialise, scratch_path


def _columns_of(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{name}`") for name in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores below its threshold.

    It learns from labelled documents of this input, held-out ones aside.
    """
    measured = quality_model.measure(docs.select("doc_id", "text"), keep_text=False)
    labels = table(spark, sf_dir, "labels")
    model = quality_model.fit(measured, labels, trainable=crc_remainder(F.col("doc_id"), 5) != 0)
    numbers, score = free_name(docs, "statistics"), free_name(docs, "score")
    scored = quality_model.score(quality_model.measure(docs, out=numbers), model, column=numbers, out=score)
    return _columns_of(scored.filter(F.col(score) >= quality_model.KEEP_FROM), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group.

    Groups link texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.
    Equal ids with different texts are told apart; of repeated rows one stays. Texts
    without words form no groups.
    """
    own = free_name(docs, "group_key")
    keyed = docs.withColumn(own, F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text")))
    linked = jaccard_join.link(keyed.select(own, "text"), key=own)
    first = linked.filter(F.col(own) == F.col("component_id")).select(own).distinct()
    return _columns_of(keyed.join(first, own, "left_semi").dropDuplicates([own]), docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind and bring n_chars up to date."""
    found = secret_scan.scan(docs, scratch_path(spark, "ledger"))
    clean = secret_scan.redact(found)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("findings") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return _columns_of(clean, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source up to its target; a row appears once for each epoch that takes it.

    The row at the cut of a source appears whole. Rows without words (null or blank texts) have
    no copies and leave the mix, although no target excludes them.
    """
    mixed = mixing.mix(docs).filter("copies > 0")
    return _columns_of(mixed.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digest of what they decode to."""
    import public_tokenizers

    serialised = byte_bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    columns = docs.select("doc_id", "lang", "source", "text")
    encoded = byte_bpe.encode(columns, serialised, offsets=False, keep_text=False)
    return byte_bpe.decode(encoded, serialised).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", keep_good),
    ("jaccard_join", keep_one_of_each_group),
    ("secret_scan", blank_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: A fitted classifier and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
