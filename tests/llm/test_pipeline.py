from collections import Counter

import corpus_pipeline
import public_tokenizers
from helpers import document_rows, documents
from pyspark.sql import functions as F
from test_search_and_join import brute_groups, chained_rows
from tokenizers import Tokenizer

from touchline.llm import byte_bpe, mixing, secret_scan


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def save(spark, tmp_path, rows):
    folder = str(tmp_path)
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] < 600)) for r in rows if r[0] is not None and (r[0] < 60 or r[0] >= 600)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_in_order_over_awkward_documents(spark, tmp_path):
    rows = document_rows(10, plain=60) + [(600 + i, f"### {i} !! " * 30, "en", "s", 0) for i in range(60)]
    rows += [(70, "Here password=abcdefghij is kept in an ordinary sentence of a document.", "en", "s1", 70)]
    folder = save(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = stage("quality_classifier")(spark, docs, folder)
    assert good.columns == docs.columns
    kept = good.collect()
    ids = {r["doc_id"] for r in kept}
    assert ids.isdisjoint(range(600, 660)) and set(range(60)) <= ids and 70 in ids
    single = stage("jaccard_join")(spark, good, folder)
    assert single.columns == docs.columns
    groups = brute_groups([tuple(r) for r in kept], 5, 80, 100)
    left = single.collect()
    told_apart = {(r["doc_id"], r["text"]) for r in left}
    assert len(told_apart) == len(left) and told_apart <= {(r["doc_id"], r["text"]) for r in kept}
    assert {r["doc_id"] for r in left} - {303, None} == {eval(g)[2] for g in groups} - {303, None}
    safe = stage("secret_scan")(spark, single, folder)
    assert safe.columns == docs.columns and safe.count() == len(left)
    row = safe.filter("doc_id = 70").first()
    assert "[assign] is kept" in row["text"] and row["n_chars"] == len(row["text"])
    mixed = stage("mixing")(spark, safe, folder)
    assert mixed.columns == docs.columns
    copies = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.mix(safe).collect()}
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == {k: n for k, n in copies.items() if n}
    final = stage("byte_bpe")(spark, mixed, folder).collect()
    engine = Tokenizer.from_str(byte_bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in final) == Counter(
        (r["doc_id"], tuple(engine.encode(r["text"] or "").ids)) for r in mixed.collect()
    )
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, final))


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, tmp_path):
    rows = document_rows(11, plain=8) + chained_rows(2)[:12]
    folder = save(spark, tmp_path, rows)
    names = ("score", "statistics", "group_key", "component_id", "findings_", "copies_", "doc", "node", "mix_draw")
    wide = spark.read.parquet(f"{folder}/documents.parquet").withColumns({n: F.lit(n) for n in names})
    for empty in (False, True):
        docs = wide.limit(0) if empty else wide
        for name, run in corpus_pipeline.STAGES[:-1]:
            docs = run(spark, docs, folder)
            assert docs.columns == wide.columns, name
        found = docs.select(*names).distinct().collect()
        assert found == ([] if empty else [names])
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0) == empty


def test_one_stage_per_operator():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert secret_scan.RULES and all(callable(f) for _, f in corpus_pipeline.STAGES)
