import math
from collections import Counter

import numpy as np
import pytest
from helpers import document_rows, documents
from pyspark.sql import functions as F

from touchline.llm import class_lm, quality_model


def test_trees_learn_and_walk_alike():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(4000, len(quality_model.STATISTICS)))
    labels = ((values[:, 0] > 0) ^ (values[:, 1] > 0.5)).astype(float)
    model = quality_model.fit_trees(values[:3000], labels[:3000])
    assert ((model.scores(values[3000:]) >= 0.5) == labels[3000:]).mean() > 0.95

    def walk(row):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            total += leaf[at - len(feature)]
        return total

    assert np.allclose(model.margins(values[:50]), [walk(row) for row in values[:50]])


def test_one_label_or_none_gives_a_constant():
    none = quality_model.fit_trees(np.empty((0, 0)), np.empty(0))
    assert none.scores(np.zeros((2, 24))).tolist() == [0.5, 0.5]
    good = quality_model.fit_trees(np.zeros((8, 24)), np.ones(8))
    assert good.scores(np.zeros((1, 24)))[0] == pytest.approx(0.9)


def test_scores_of_awkward_documents(spark):
    junk = [(600 + i, f"### {i} !! " * 30, "en", "s", 0) for i in range(60)]
    rows = document_rows(7, plain=60) + junk
    docs = documents(spark, rows).withColumns({"statistics": F.lit("x"), "score": F.lit("y"), "label": F.lit(1), "values": F.lit(2)})
    labels = spark.createDataFrame(
        [(r[0], int(r[0] < 600)) for r in rows if r[0] is not None and (r[0] < 60 or r[0] >= 600)]
        + [(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, quality int",
    )
    measured = quality_model.measure(docs)
    model = quality_model.fit(measured, labels)
    out = quality_model.score(measured, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out) and {r["label"] for r in out} == {1}
    assert min(r["score"] for r in out if (r["doc_id"] or 99) < 60) > max(r["score"] for r in out if (r["doc_id"] or 0) >= 600)
    empty = quality_model.measure(documents(spark, []))
    assert quality_model.score(empty, quality_model.fit(empty, labels)).count() == 0


def tokens(text):
    return (text or "").encode().lower().split() + [None]


@pytest.mark.parametrize("frequent", [1, 20, class_lm.FREQUENT_WORDS])
def test_scores_equal_brute_force(spark, frequent):
    rows = document_rows(8)
    docs = documents(spark, rows).withColumns({"score": F.lit("x"), "word": F.lit("w"), "row_id": F.lit(7)})
    model = class_lm.train(docs.filter("doc_id % 3 <> 0"), frequent_words=frequent, exchanged_words=16, classes=4)
    trained = Counter(t for r in rows if r[0] is not None and r[0] % 3 for t in tokens(r[1]))
    total, distinct = sum(trained.values()), len(trained)
    out = class_lm.score(docs, model).collect()
    assert len(out) == len(rows) and {(r["word"], r["row_id"]) for r in out} == {("w", 7)}
    states = class_lm.States(model.frequent, model.exchanged)

    def state(token):
        return states.end if token is None else int(states.state_of[states.code([token])[0]])

    held = Counter()
    for token, n in trained.items():
        held[model.classes[state(token)]] += n + 1
    for at in range(model.exchanged, states.end):
        held[model.classes[at]] += 1
    pairs = Counter()
    for r in rows:
        if r[0] is not None and r[0] % 3:
            path = [states.end] + [state(t) for t in tokens(r[1])]
            pairs.update((model.classes[a], model.classes[b]) for a, b in zip(path, path[1:]))
    groups = int(model.classes.max()) + 1
    before = Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    by_row = {(r["doc_id"], n): r for r in out for n in [r["n_tokens"]]}
    for doc, text, *_ in rows:
        own = tokens(text)
        row = by_row[doc, len(own)]
        assert model.tokens == total
        assert row["n_known"] == sum(trained[t] > 0 for t in own)
        base = sum(math.log10((trained[t] + 1) / (total + distinct + 1)) for t in own)
        assert row["base_score"] == pytest.approx(base)
        path = [states.end] + [state(t) for t in own]
        score = sum(
            math.log10((pairs[model.classes[a], model.classes[b]] + 0.1) / (before[model.classes[a]] + 0.1 * groups))
            for a, b in zip(path, path[1:])
        ) + sum(math.log10((trained[t] + 1) / held[model.classes[state(t)]]) for t in own if t is not None)
        assert row["score"] == pytest.approx(score)


def test_exchange_finds_the_classes_of_a_grammar():
    rng = np.random.default_rng(1)
    words, kinds = 12, np.arange(12) // 4
    counts = np.zeros((13, 13))
    previous = 12
    for step in range(20_000):
        kind = (step % 3)
        word = int(rng.choice(np.flatnonzero(kinds == kind)))
        counts[previous, word] += 1
        previous = word
    own = class_lm.exchange(counts, words, classes=3)
    assert all(len({own[w] for w in range(words) if kinds[w] == kind}) == 1 for kind in range(3))
    assert len(set(own[:words])) == 3


def test_no_single_move_of_the_exchange_raises_the_likelihood():
    rng = np.random.default_rng(5)
    counts = rng.poisson(rng.gamma(0.3, 40, (23, 23))).astype(float)
    own = class_lm.exchange(counts, 20, classes=4)

    def reached(classes):
        member = np.eye(7)[classes]
        return class_lm.likelihood(member.T @ counts @ member)

    for word in range(20):
        for other in range(4):
            moved = own.copy()
            moved[word] = other
            assert reached(moved) <= reached(own) + 1e-6


def grammar_rows(texts=60, kinds=3, each=20, length=90):
    """Words of one shape; the kind of a word follows from the kind before it."""
    rng = np.random.default_rng(4)
    rows = []
    for doc in range(texts):
        picks = np.minimum(rng.geometric(0.2, length) - 1, each - 1)
        rows.append((doc, " ".join(f"w{'abc'[at % kinds]}{'abcdefghijklmnopqrst'[p]}" for at, p in enumerate(picks)), "en", "s", 0))
    return rows


def test_words_outside_the_seeds_are_exchanged_too(spark):
    docs = documents(spark, grammar_rows())
    model = class_lm.train(docs, frequent_words=8, seed_words=6, classes=3)
    found = {bytes(r["word"]).decode(): r["class"] for r in model.vocabulary.collect()}
    assert len(found) > 50 and model.exchanged == 6
    by_kind = {kind: {c for word, c in found.items() if word[1] == kind} for kind in "abc"}
    assert all(len(classes) == 1 for classes in by_kind.values())
    assert len(set.union(*by_kind.values())) == 3


@pytest.mark.parametrize("frequent", [1, 30, class_lm.FREQUENT_WORDS])
def test_scores_of_all_exchanged_words_equal_brute_force(spark, frequent):
    rows = document_rows(8)
    docs = documents(spark, rows)
    model = class_lm.train(docs.filter("doc_id % 3 <> 0"), frequent_words=frequent, seed_words=16, classes=4)
    class_of = {bytes(r["word"]): r["class"] for r in model.vocabulary.collect()}
    trained = Counter(t for r in rows if r[0] is not None and r[0] % 3 for t in tokens(r[1]))
    assert set(class_of) | {None} == set(trained) and set(class_of.values()) <= set(range(4))
    groups, end = len(model.transitions), len(model.transitions) - 1

    def kind(token):
        return end if token is None else class_of.get(token, 4 + class_lm.shape(token))

    pairs, before, held = Counter(), Counter(), Counter(range(4, end))
    for r in rows:
        if r[0] is not None and r[0] % 3:
            path = [end] + [kind(t) for t in tokens(r[1])]
            pairs.update(zip(path, path[1:]))
            for at, token in enumerate(tokens(r[1]), 1):
                if token is not None and trained[token] == 1:
                    as_shape = 4 + class_lm.shape(token)
                    pairs.update([(path[at - 1], as_shape), (as_shape, path[at + 1])])
    for (a, _), n in pairs.items():
        before[a] += n
    for token, n in trained.items():
        held[kind(token)] += n + 1
    out = {(r["doc_id"], r["n_tokens"]): r for r in class_lm.score(docs, model).collect()}
    for doc, text, *_ in rows:
        own = tokens(text)
        path = [end] + [kind(t) for t in own]
        score = sum(math.log10((pairs[a, b] + 0.1) / (before[a] + 0.1 * groups)) for a, b in zip(path, path[1:]))
        score += sum(math.log10((trained[t] + 1) / held[kind(t)]) for t in own if t is not None)
        assert out[doc, len(own)]["score"] == pytest.approx(score)


def test_exchanged_words_go_by_rank_whatever_travels(spark):
    docs = documents(spark, [(1, "e d c b a f", "en", "s", 0), (2, "f a b c d e", "en", "s", 0)])
    for travel in (1, 4, 100):
        model = class_lm.train(docs, frequent_words=travel, exchanged_words=3, classes=2)
        assert model.exchanged == 3 and model.frequent[:3] == [b"a", b"b", b"c"]


def test_training_on_nothing(spark):
    model = class_lm.train(documents(spark, []))
    out = class_lm.score(documents(spark, [(1, "a b", "en", "s", 0), (2, None, None, None, None)]), model).collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"]) for r in sorted(out)] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert class_lm.score(documents(spark, []), model).count() == 0


def test_sweeps_over_rare_words_keep_no_news_of_older_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(n)}" for n in rng.zipf(1.3, 60) % 900) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, likelihood = [], class_lm.likelihood

    def counting(pairs):
        found.append(sum(row.tableName.startswith("rare_") for row in spark.sql("SHOW TABLES").collect()))
        return likelihood(pairs)

    monkeypatch.setattr(class_lm, "likelihood", counting)
    written, materialise = [], class_lm.materialise
    monkeypatch.setattr(class_lm, "materialise", lambda df: written.append(df) or materialise(df))
    class_lm.train(docs, frequent_words=40, classes=6, seed_words=20)
    sweeps = [count for count in found if count]
    # The words themselves, the news of this sweep, of the one before and of the best one.
    assert len(sweeps) > 4 and max(sweeps) <= 4
    # The vocabulary, the bigrams and the classes found are written as tables of the run, no sweep is.
    assert len(written) == 3
    assert not [row for row in spark.sql("SHOW TABLES").collect() if row.tableName.startswith("rare_")]


def test_texts_are_cut_once_for_all_passes(spark):
    rows = document_rows(8)
    plain = documents(spark, rows)
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    docs = plain.withColumn("text", F.udf(seen, "string")("text"))
    given = {"frequent_words": 20, "seed_words": 16, "classes": 4}
    texts = class_lm.encode(docs, learn=F.expr("doc_id % 3 <> 0"))
    out = class_lm.score(texts, class_lm.train(texts, **given)).collect()
    assert read.value == len(rows)
    apart = class_lm.score(plain, class_lm.train(plain.filter("doc_id % 3 <> 0"), **given)).collect()
    assert Counter(map(tuple, (r[:-2] for r in out))) == Counter(map(tuple, (r[:-2] for r in apart)))
    assert sorted(r["score"] for r in out) == pytest.approx(sorted(r["score"] for r in apart))


def test_moves_change_the_counts_of_their_bigrams_alone(spark):
    texts = class_lm.encode(spark.createDataFrame([(row[0], row[1]) for row in grammar_rows()], "doc_id long, text string"))
    frequent = [bytes(r["word"]) for r in class_lm.count_words(texts).orderBy("word").limit(30).collect()]
    bigrams = class_lm.Bigrams(texts, frequent, 5_400)
    rng = np.random.default_rng(2)
    fixed = np.arange(5, 5 + class_lm.SHAPES + 1)
    before = np.concatenate([rng.integers(0, 5, 30), fixed])
    after = np.where((rng.random(len(before)) < 0.4) & (before < 5), (before + 1) % 5, before)
    groups = int(fixed[-1]) + 1
    assert (bigrams.pairs(before, groups) + bigrams.changed(before, after, groups) == bigrams.pairs(after, groups)).all()
