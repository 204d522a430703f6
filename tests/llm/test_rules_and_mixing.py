from collections import Counter

import pytest
from helpers import document_rows, documents, words
from pyspark.sql import functions as F

from touchline.llm import mixing, quality_rules


def brute_rules(text):
    text = text or ""
    found = words(text)
    grams = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = set()
    for i in range(len(found) - 7):
        if grams[tuple(found[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if words(line)]
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(found) < 20 or 100 * len(covered) > 30 * len(found),
    }


def test_rules_equal_brute_force(spark):
    rows = document_rows(1) + [(400, "a b c d e f g h i\n" * 4 + "z", "en", "s", 1), (401, "# | < a&b\n\nx\nx\n y", "en", "s", 1)]
    got = quality_rules.clean(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    for row in got:
        want = brute_rules(row["text"])
        assert {name: row[name] for name in want} == want
        assert not (row["base_failed"] and row["kept"])


def test_lines_that_fail_are_removed_and_decide(spark):
    good = "This line is an ordinary sentence, long enough to count as prose for the rules."
    menu = "Home | News | Sport | Shop | About"
    shout = "BUY!! NOW!! CHEAP!! ONLY!! TODAY!!"
    licence = "All rights reserved by the owner of this page."
    text = "\n".join([good, menu, shout, licence, good + " Again."])
    rows = [(1, text, "", "", 0), (2, "\n".join([menu, good, "A second sentence of prose, with words of its own."]), "", "", 0),
            (3, "\n".join([good] + [f"Home{i} | Page{i} | Shop{i} | About{i}" for i in range(9)]), "", "", 0)]
    got = {r["doc_id"]: r for r in quality_rules.clean(documents(spark, rows)).collect()}
    assert got[1]["clean_text"] == good + "\n" + good + " Again."
    assert {r["rule"]: r["lines"] for r in got[1]["failed_lines"]} == {"boilerplate": 1, "navigation": 1, "punctuation": 1}
    assert got[2]["kept"] and not got[3]["kept"]


def test_rules_with_clashing_columns_and_empty_table(spark):
    docs = documents(spark).limit(3).withColumns({n: F.lit("x") for n in ("kept", "n_words", "rule_body", "rule_words", "n_repeat_words_h1")})
    out = quality_rules.clean(docs)
    assert out.select("rule_body", "rule_words", "n_repeat_words_h1").distinct().collect() == [("x", "x", "x")]
    assert out.filter("kept is null").count() == 0
    assert quality_rules.clean(documents(spark, [])).count() == 0


def brute_targets(sizes):
    """Share by weight, cut at three times the source, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return target
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] >= 3 * sizes[s]]
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            full.add(s)


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_mix_reaches_targets_exactly(spark, bucket):
    rows = document_rows(2)
    got = mixing.mix(documents(spark, rows), rows_per_bucket=bucket).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len(words(row[1]))
    want = brute_targets(dict(sizes))
    taken = Counter()
    for row in got:
        assert row["size"] == len(words(row["text"])) and row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(want[row["source"]])
        assert 0 <= row["taken"] <= 3 * row["size"] and row["copies"] <= 3
        assert (row["copies"] > 0) == (row["taken"] > 0)
        taken[row["source"]] += row["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix_is_the_same_for_any_bucket_size_and_rerun(spark):
    docs = documents(spark, document_rows(3)).select("doc_id", "text", "source").repartition(5)
    runs = [sorted(map(tuple, mixing.mix(docs, rows_per_bucket=n).collect()), key=repr) for n in (2, 7, 20_000, 20_000)]
    assert all(run == runs[0] for run in runs)


def test_mix_with_clashing_columns_nulls_and_empty_table(spark):
    docs = documents(spark).withColumns({n: F.lit("x") for n in ("target", "mix_draw", "range", "offset", "plan_source")})
    out = mixing.mix(docs)
    assert out.select("mix_draw", "range", "offset", "plan_source").distinct().collect() == [("x",) * 4]
    assert mixing.mix(documents(spark, [])).count() == 0
    blank = documents(spark, [(1, None, None, None, None), (2, " ", None, "a", 1)])
    assert [tuple(r) for r in mixing.mix(blank).select("target", "taken").collect()] == [(0.0, 0), (0.0, 0)]
