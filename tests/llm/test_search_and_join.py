import math
import random

import numpy as np
import pytest
from helpers import document_rows, documents
from pyspark.sql import functions as F

from touchline.llm import exact_topk, jaccard_join

VECTORS = "vec_id long, embedding array<float>, length string, id string, rank int"


def vector_rows(seed, n=300, dims=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dims) * (0.1 + i % 7)], "l", "i", 1) for i in range(n)]
    rows += [(1000 + i, rows[10][1], "l", "i", 1) for i in range(40)]
    rows += [(2000, None, "l", "i", 1), (2001, [1.0, None] * 3, "l", "i", 1), (2002, [math.nan] * 6, "l", "i", 1)]
    rows += [(2003, [math.inf] * 6, "l", "i", 1), (2004, [0.0] * 6, "l", "i", 1), (2005, [1.0, 2.0], "l", "i", 1)]
    return rows + [(2006, [2.0, 1.0], "l", "i", 1), (None, [9.0] * 6, "l", "i", 1), rows[20], rows[50]]


def brute_top(rows, k):
    usable = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = sorted((i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in usable)
    out = []
    for query, q in whole:
        if query % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in whole if i != query and len(v) == len(q))
            out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows,query_rows", [(32, 3), (8192, 4096)])
def test_top_k_equals_brute_force(spark, block_rows, query_rows):
    rows = vector_rows(3)
    df = spark.createDataFrame(rows, VECTORS)
    got = exact_topk.top_k(df, df.filter("vec_id % 50 = 0"), block_rows=block_rows, query_rows=query_rows)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)


def test_coordinates_prune_without_loss():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 16)) * 200
    vectors = np.floor(np.repeat(base, 30, axis=0) + rng.normal(size=(600, 16)) * 5)
    ids = np.arange(600)
    full = exact_topk.search_block(vectors[:20], ids[:20], np.full(20, -np.inf), vectors, ids, 5)
    bars = {q: min(s for a, _, s in full if a == q) for q in range(20)}
    least = np.array([bars[q] for q in range(20)], float)
    assert sorted(exact_topk.search_block(vectors[:20], ids[:20], least, vectors, ids, 5)) == sorted(full)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    own = np.sqrt((vectors[:20] ** 2).sum(axis=1))
    local = least / (own * lengths.max())
    mask = exact_topk._candidates(vectors[:20], own, local, least, vectors, lengths, 1e-9)
    assert mask.mean() < 0.5


def test_huge_components_and_few_candidates(spark):
    rows = [(0, [1e30, 1.0], "", "", 0), (1, [1e30, 0.0], "", "", 0), (2, [-1.0, 3.0], "", "", 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in exact_topk.top_k(df, df.filter("vec_id = 0")).collect()]
    assert got[0] == (0, 1, 1, 2**63 - 1) and len(got) == 2
    assert exact_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_groups(rows, width, numerator, denominator):
    def of(text):
        words = (text or "").encode().lower().split()
        if not words:
            return frozenset()
        return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))

    sets = [of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if denominator * common >= numerator * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted(repr((r[0], len(s), least.get(find(i)))) for i, (r, s) in enumerate(zip(rows, sets)))


def chained_rows(seed):
    """Chains whose neighbours link but whose ends do not, and shared passages that link nothing."""
    rng = random.Random(seed)
    rows = []
    for chain in range(4):
        words = [f"c{chain}w{i}" for i in range(150)]
        for step in range(12):
            for at in range(step * 12, step * 12 + 2):
                words[at] = f"c{chain}x{step}at{at}"
            rows.append((1000 + 100 * chain + step, " ".join(words), "en", "s", 0))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(3000 + i, passage + " " + " ".join(f"u{rng.random()}" for _ in range(rng.randint(3, 60))), "en", "s", 0) for i in range(60)]
    return rows


@pytest.mark.parametrize("width,numerator,block", [(4, 85, 128), (5, 80, 128), (4, 85, 5)])
def test_groups_equal_brute_force(spark, monkeypatch, width, numerator, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)
    rows = document_rows(9) + chained_rows(1)
    docs = documents(spark, rows).withColumns({"doc": F.lit("x"), "node": F.lit("y"), "digest": F.lit("z"), "label": F.lit("l")})
    got = jaccard_join.link(docs, width=width, numerator=numerator, denominator=100)
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == brute_groups(rows, width, numerator, 100)


def test_join_of_an_empty_table_and_of_blanks(spark):
    assert jaccard_join.link(documents(spark, [])).count() == 0
    blanks = documents(spark, [(1, None, None, None, None), (2, "", "", "", 0), (None, " ", "", "", 0)])
    assert sorted(map(repr, map(tuple, jaccard_join.link(blanks).collect()))) == ["(1, 0, 1)", "(2, 0, 2)", "(None, 0, None)"]


def test_long_texts_are_cut_between_words():
    text = " ".join(f"w{i % 977}" for i in range(400_000)).encode()
    whole = jaccard_join.shingles(text, 4)
    tuples = {tuple(text.split()[i : i + 4]) for i in range(0, 977)}
    assert len(whole) >= len(tuples)
    assert len(jaccard_join.shingles(b"A b\tC", 4)) == 1
    assert (jaccard_join.shingles(b"A b\tC", 4) == jaccard_join.shingles(b"a B c", 4)).all()
