"""The corpus queries and, where SQL can express them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import reference_sql
from touchline.llm.common import crc_remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm.quality_rules import clean

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return clean(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "kept_words",
    )


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from touchline.llm.byte_bpe import decode, encode, tokenizer_json

    serialised = tokenizer_json(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    decoded = decode(encode(docs, serialised, offsets=False, keep_text=False), serialised)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm import warc
    from touchline.session import scratch_path

    path = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    records = warc.read(spark, path, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm.secret_scan import BASE_KINDS, scan, span_text
    from touchline.session import scratch_path

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scan(docs, scratch_path(spark, "ledger"))

    def of(*kinds: str) -> Column:
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(span_text(of(*BASE_KINDS)), 256).alias("base_sha256"),
        span_text(F.col("findings")).alias("spans"),
    )


def op5_token_store(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from touchline.llm import token_store
    from touchline.session import scratch_path

    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "tokens")
    entries = token_store.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    fetched = token_store.fetch(token_store.lookup(entries.select("key", "copy"), path), path)
    return fetched.join(token_store.shard_starts(spark, path), "shard", "left").select(
        F.col("key").alias("doc_id"),
        (F.col("shard_start") + F.col("place")).alias("start"),
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op6_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm.exact_topk import top_k

    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(vectors.vec_id % 50 == 0), k=5)


def op7_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm import quality_model
    from touchline.session import materialise

    docs = table(spark, folder, "documents").select("doc_id", "text")
    measured = materialise(quality_model.measure(docs, keep_text=False))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    model = quality_model.fit(measured, labels, trainable=~held_out)
    return quality_model.score(measured, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= quality_model.KEEP_FROM).cast("int").alias("predicted"),
    )


def op8_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm import class_lm

    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    texts = class_lm.encode(docs, learn=~held_out)
    model = class_lm.train(texts)
    return class_lm.score(texts, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm.jaccard_join import link

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return link(docs, width=4, numerator=85, denominator=100)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm.mixing import mix, word_count
    from touchline.session import materialise

    docs = table(spark, folder, "documents")
    sizes = materialise(docs.select("doc_id", "source", word_count(docs.text).alias("words")))
    mixed = mix(sizes, size=sizes.words)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm import merkle

    docs = table(spark, folder, "documents")
    shortened = F.when(crc_remainder(docs.doc_id, 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(docs.text)
    changed = merkle.leaf([shortened if name == "text" else docs[name] for name in merkle.FIELDS])
    proofs = merkle.prove(docs, keep={"changed_leaf": changed})
    return proofs.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.sibling_text(F.col("siblings")), 256).alias("proof_sha256"),
        merkle.fold(F.col("changed_leaf"), F.col("siblings")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm.pii import BASE_KINDS, scan, span_text

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scan(docs, keep_text=False)

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(span_text(of(*BASE_KINDS)), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from touchline.llm.periodic_runs import detect

    docs = table(spark, folder, "documents").select("doc_id", "text")
    number = F.crc32(F.coalesce(docs.doc_id.cast("string"), F.lit("")).cast("binary"))
    found = detect(docs, planted=F.when(number % 10 == 0, F.floor(number / 10)), keep_text=False)
    best = F.get("runs", F.col("strongest"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * runs[strongest].length div runs[strongest].period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def all_queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_warc": op3_warc,
        "op4_secret_scan": op4_secret_scan,
        "op5_token_store": op5_token_store,
        "op6_exact_topk": op6_exact_topk,
        "op7_quality_model": op7_quality_model,
        "op8_class_lm": op8_class_lm,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_mixing": op10_mixing,
        "op11_merkle": op11_merkle,
        "op12_pii": op12_pii,
        "op13_periodic_runs": op13_periodic_runs,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op1_quality_rules": reference_sql.QUALITY_RULES,
        "op3_warc": reference_sql.WARC,
        "op4_secret_scan": reference_sql.SECRET_SCAN,
        "op6_exact_topk": reference_sql.EXACT_TOPK,
        "op9_jaccard_join": reference_sql.JACCARD_JOIN,
        "op10_mixing": reference_sql.MIXING,
        "op11_merkle": reference_sql.MERKLE,
        "op12_pii": reference_sql.PII,
    }
