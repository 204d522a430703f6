import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import document_rows, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import byte_bpe, token_store

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def serialised():
    return byte_bpe.tokenizer_json(RANKS, public_tokenizers.PATTERN)


def key(row):
    return (repr(row[0]), repr(row[1]))


def test_encode_equals_the_rank_library_and_decodes(spark, serialised):
    rows = document_rows(4)
    other = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )
    encoded = byte_bpe.encode(documents(spark, rows), serialised)
    got = byte_bpe.decode(encoded, serialised, per_token=True).collect()
    assert sorted((key((r["doc_id"], r["text"])) for r in got)) == sorted(key((r[0], r[1] or "")) for r in rows)
    whole = Tokenizer.from_str(serialised)
    for row in got:
        assert row["ids"] == other.encode_ordinary(row["text"])
        assert bytes(row["decoded"]).decode() == row["text"] == "".join(row["token_texts"])
        assert len(row["token_texts"]) == len(row["ids"])
        if len(row["text"]) < 10_000:
            assert list(zip(row["starts"], row["ends"])) == whole.encode(row["text"]).offsets


def test_characters_split_over_tokens(spark, serialised):
    df = spark.createDataFrame([(1, "🙂x")], "doc_id int, text string")
    row = byte_bpe.decode(byte_bpe.encode(df, serialised), serialised, per_token=True).first()
    assert len(row["ids"]) > 2 and "".join(row["token_texts"]) == "🙂x" and "" in row["token_texts"]
    odd = spark.createDataFrame([(1, [5, None, 10**6, -1]), (2, None), (3, [])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(odd, serialised).collect()}
    assert got == {1: "&" + "�" * 3, 2: "", 3: ""}


def test_encode_with_clashing_columns_and_empty_table(spark, serialised):
    docs = documents(spark).limit(2).withColumns({"ids": F.lit("x"), "decoded": F.lit(1), "starts": F.lit(2)})
    out = byte_bpe.decode(byte_bpe.encode(docs, serialised), serialised)
    assert dict(out.dtypes)["ids"] == "array<int>" and dict(out.dtypes)["decoded"] == "binary"
    assert out.count() == 2
    assert byte_bpe.decode(byte_bpe.encode(documents(spark, []), serialised), serialised).count() == 0


def test_store_reads_back_what_the_library_encodes(spark, tmp_path):
    rows = document_rows(5)
    path = f"{tmp_path}/store"
    docs = documents(spark, rows).withColumns({"key": F.lit("x"), "shard": F.lit("y")})
    entries = token_store.write(docs, path, WORDS, end_id=2)
    located = token_store.lookup(entries.select("key", "copy"), path)
    starts = {r["shard"]: r["shard_start"] for r in token_store.shard_starts(spark, path).collect()}
    got = sorted(
        ((r["key"] is not None, r["key"], starts[r["shard"]] + r["place"], bytes(r["ids"])) for r in token_store.fetch(located, path).collect()),
        key=lambda r: r[2],
    )
    engine = Tokenizer.from_file(WORDS)
    want = [np.array(engine.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for r in rows]
    assert sorted((r[1] is not None, r[1] or 0, zlib.crc32(r[3])) for r in got) == sorted(
        (r[0] is not None, r[0] or 0, zlib.crc32(w)) for r, w in zip(rows, want)
    )
    assert [r[1] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    position = 0
    for row in got:
        assert row[2] == position
        position += len(row[3]) // 4
    missing = spark.createDataFrame([(10**9, 0), (303, 7), (None, 1)], "key long, copy int")
    assert all(r["shard"] is None and r["ids"] is None for r in token_store.fetch(token_store.lookup(missing, path), path).collect())


def test_store_of_an_empty_table(spark, tmp_path):
    entries = token_store.write(documents(spark, []), f"{tmp_path}/store", WORDS)
    assert token_store.fetch(token_store.lookup(entries.select("key", "copy"), f"{tmp_path}/store"), f"{tmp_path}/store").count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    hashes = token_store.key_hashes([f"k{i}" for i in range(5000)])
    sizes, bits = token_store.build_hash(hashes)
    before = np.cumsum(bits) - bits
    assert sorted(token_store.find(hashes, sizes, bits, before)) == list(range(5000))
    prints = np.empty(5000, np.uint64)
    prints[token_store.find(hashes, sizes, bits, before)] = hashes[:, 1] >> np.uint64(32)
    others = token_store.key_hashes([f"x{i}" for i in range(5000)])
    at = token_store.find(others, sizes, bits, before)
    hit = at >= 0
    assert (prints[at[hit]] == (others[hit, 1] >> np.uint64(32))).sum() == 0


def test_piece_encoder_equals_the_library():
    engine = Tokenizer.from_file(WORDS)
    encode = byte_bpe.PieceEncoder(engine)
    pieces = ["Don't", "ÀÉÎ12a", "<|endoftext|>", "İx", "漢字", "...", "a_b", "ŉǅ", "é"]
    assert [np.frombuffer(b, "<i4").tolist() for b in encode(pieces)] == [
        engine.encode(p, add_special_tokens=False).ids for p in pieces
    ]
    assert hashlib.sha256(b"".join(encode([]))).hexdigest() == hashlib.sha256(b"").hexdigest()
