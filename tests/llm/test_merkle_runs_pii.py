import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from helpers import DOCS, document_rows, documents, words
from pyspark.sql import functions as F

from touchline.llm import merkle, periodic_runs, pii

# --- Merkle manifest -------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(leaves, fanout):
    """Root, and the (left, right) siblings of each leaf."""
    siblings = [[] for _ in leaves]
    level, covered = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, above_covered = [], []
        for begin in range(0, len(level), fanout):
            run = level[begin:begin + fanout]
            for at in range(len(run)):
                for i in covered[begin + at]:
                    siblings[i].append(("".join(run[:at]), "".join(run[at + 1:])))
            above.append(sha(*run))
            above_covered.append([i for group in covered[begin:begin + fanout] for i in group])
        level, covered = above, above_covered
    return level[0], siblings


def plain_proofs(rows, fanout):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append(((row[0] is not None, row[0] or 0), plain_leaf(row)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        leaves = sorted(by_source[source])
        trees[source] = (leaves, *plain_tree([leaf for _, leaf in leaves], fanout))
    root, upper = plain_tree([trees[s][1] for s in sources], fanout)
    out = []
    for source, above in zip(sources, upper):
        leaves, subroot, siblings = trees[source]
        out += [(source, key[1] if key[0] else None, leaf, subroot, root, steps + above) for (key, leaf), steps in zip(leaves, siblings)]
    return out


@pytest.mark.parametrize("fanout, rows_per_range", [(3, 7), (3, 50_000), (2, 20)])
def test_proofs_equal_plain_trees(spark, fanout, rows_per_range):
    rows = document_rows()
    docs = documents(spark, rows).withColumn("tree", F.lit("clash")).withColumn("lo", F.lit(1)).withColumn("digest", F.lit("x"))
    proofs = merkle.prove(docs, fanout=fanout, rows_per_range=rows_per_range, keep={"digest": F.col("digest")})
    assert proofs.columns == ["doc_id", "source", "leaf", "subroot", "root", "siblings", "digest"]
    got = [
        (r["source"], r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["siblings"]]) for r in proofs.collect()
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_proofs(rows, fanout)))
    folded = proofs.filter(merkle.fold(F.col("leaf"), F.col("siblings")) != F.col("root"))
    assert folded.count() == 0
    assert proofs.filter(merkle.fold(F.sha2("leaf", 256), F.col("siblings")) == F.col("root")).count() == 0


def test_one_id_on_many_equal_rows_spreads_over_ranges(spark):
    rows = [(1, "same", "en", "hot", 4)] * 60 + [(2, "other", "en", "hot", 4), (None, None, None, None, None)]
    got = merkle.prove(documents(spark, rows), rows_per_range=10).collect()
    want = plain_proofs(rows, 3)
    assert sorted((r["leaf"], repr([tuple(s) for s in r["siblings"]])) for r in got) == sorted((w[2], repr(w[5])) for w in want)


def test_single_row_and_empty_table(spark):
    only = merkle.prove(documents(spark, [(7, "a", "en", "s", 1)])).first()
    assert only["leaf"] == only["subroot"] == only["root"] and only["siblings"] == []
    assert merkle.prove(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        merkle.prove(documents(spark, []), keep={"Root": F.lit(1)})


# --- periodic runs ---------------------------------------------------------------------------


def plain_runs(ws):
    found = []
    for q in range(1, len(ws) // 4 + 1):
        begin = 0
        while begin + q < len(ws):
            stop = begin
            while stop + q < len(ws) and ws[stop] == ws[stop + q]:
                stop += 1
            length = stop + q - begin
            if stop > begin and length >= max(6, 4 * q):
                body = ws[begin:stop + q]
                if all(any(body[i] != body[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((begin, begin + length, q))
            begin = stop + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_grammar_finds_the_runs_of_a_plain_search():
    rng = random.Random(3)
    for _ in range(600):
        ws = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 6])]).encode() for _ in range(rng.choice([0, 5, 6, 20, 90]))]
        for _ in range(rng.randrange(4)):
            at, period = rng.randrange(len(ws) + 1), rng.randrange(1, 9)
            ws[at:at] = ws[at:at + period] * rng.randrange(2, 8)
        assert periodic_runs.find_runs(ws) == plain_runs(ws), ws


def test_long_texts_of_few_words():
    assert periodic_runs.find_runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    assert periodic_runs.find_runs([b"a", b"b", b"a"] * 20_000) == [(0, 60_000, 3)]
    fibonacci = [[b"a"], [b"a", b"b"]]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic_runs.find_runs(fibonacci[-1]) == []  # no power of four in the Fibonacci word


def test_runs_of_documents(spark):
    rows = document_rows() + [(400, "a b " * 3 + "c c c c c c c end " + "x y z " * 9, "en", "s", 0), (401, "q " * 6, "en", "s", 0)]
    docs = documents(spark, rows).withColumn("run_body", F.lit("clash")).withColumn("runs", F.lit("clash"))
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    got = periodic_runs.detect(docs, planted=F.when(number % 3 == 0, F.floor(number / 3))).collect()
    want = []
    for doc_id, text, *_ in rows:
        ws = words(text)
        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        g = h // 3
        if h % 3 == 0 and ws:
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        codes = [w.encode() for w in ws]
        # The plain search is quadratic; very long texts are covered by the test above.
        runs = plain_runs(codes) if len(ws) < 2000 else periodic_runs.find_runs(codes)
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        text_out = " ".join(w for i, w in enumerate(ws) if i not in gone)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        want.append((doc_id, [(s, e - s, q) for s, e, q in runs], sha(lines), sha(text_out)))
    assert sorted(map(repr, want)) == sorted(
        repr((r["doc_id"], [tuple(x) for x in r["runs"]], r["runs_sha256"], r["collapsed_sha256"])) for r in got
    )
    assert all(r["run_body"] == "clash" for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[401]["strongest"] == 0 or by_id[401]["runs"] == []
    assert periodic_runs.detect(documents(spark, [])).count() == 0
    assert by_id[300]["runs"] == [] and by_id[300]["strongest"] is None


def test_strongest_run_prefers_exact_exponent_then_start_then_period():
    assert periodic_runs.strongest([(0, 12, 3), (20, 28, 2), (40, 46, 1)]) == (40, 46, 1)
    assert periodic_runs.strongest([(0, 12, 3), (0, 8, 2), (5, 13, 2)]) == (0, 12, 3)
    assert periodic_runs.strongest([]) is None


# --- personal data ---------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "", re.ASCII)
        if plain_valid(kind, m.group())
    ]


ODD = [
    "a@b.c%x@d.e a@b a.b@-c.-d. @x.y x@y..z me@host.example,you@host.example",
    "1.2.3.4.5 256.1.1.1 255.255.255.255 0000255.1.1.1 1.2.3 9.9.9.9.9.9.9.9 " + "7" * 30 + ".1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5500 0000 0000 0004 12 " + "0" * 40,
    "+1 (555) 010-9999 +12 +1 2 3 4 5 6 7 8 +4(4) +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6.7.8 ++1 5555555 +9 -- 1",
    "🙂 ß me@ex.org 漢字 10.0.0.1 🙂 +49 30 1234567 é",
    "1 " * 30_000, "a@" * 5_000, "a.b@c.d " * 3000, "+" * 20_000, "9" * 10_000,
]


def test_base_spans_equal_a_plain_search(spark):
    rng = random.Random(1)
    alphabet = ["1", "2", "45", ".", "@", "a", "b-", "+1", " ", "-", "(", ")", "4111111111111111", "x@y.z", "1.2.3.4", "é"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(400)]
    rows = document_rows() + [(1000 + i, text, "en", "s", 0) for i, text in enumerate(texts)]
    got = pii.scan(documents(spark, rows).withColumn("spans", F.lit("clash")).withColumn("pii_body", F.lit("clash"))).collect()
    base = [(r["doc_id"], r["text"], [tuple(s) for s in r["spans"] if s["kind"] in pii.BASE_KINDS]) for r in got]
    assert sorted(map(repr, base)) == sorted(repr((d, t, plain_spans(t))) for d, t, *_ in rows)
    assert pii.scan(documents(spark, [])).count() == 0


def rare_word_rows():
    rng = random.Random(5)
    common = ["the", "of", "and", "house", "river", "stone", "cloud", "green"]
    rows = []
    for i in range(400):
        body = rng.choices(common, k=30)
        if i in (3, 50, 90):
            body[10:10] = ["Zarquon,", "mayor@town.example", "the"]
            body[2:2] = ["zarquon"]
        if i in (7, 8):
            body[5:5] = ["Brantorium", "10.1.2.3"]
        if 100 <= i < 130:
            body[5:5] = [f"bra{rng.choice('xyz')}ket"]
        if i in (200, 201):
            body[5:5] = ["+1 555 010 9999", "the", "river"]
        rows.append((i, " ".join(body), "en", "s", 0))
    unique = "Quodlibet wrote to solo@only.example yesterday"
    return rows + [(500 + i, unique, "en", "s", 0) for i in range(5)] + [(600, "Zarquon alone", "en", "s", 0), (601, None, "en", "s", 0)]


def test_terms_that_disclose_an_entity(spark):
    rows = rare_word_rows()
    scanned = pii.scan(spark.createDataFrame(rows, DOCS))
    got = {r["doc_id"]: r for r in scanned.collect()}

    def terms(doc_id):
        row = got[doc_id]
        return [(s["kind"], row["text"][s["start"]:s["end"]]) for s in row["spans"] if s["kind"] in pii.TERM_KINDS]

    # Both mentions go in texts that hold the address; words beginning "zar" are as telling as the name.
    for doc_id in (3, 50, 90):
        assert terms(doc_id) == [("removed", "zarquon"), ("removed", "Zarquon")]
    # "bra*" covers many other texts, so the place is only generalised.
    assert terms(7) == [("generalised", "Brantorium")] == terms(8)
    # Frequent words, words of a single (copied) text, and texts without entities stay.
    for doc_id in (200, 201, 500, 504, 600, 601, 110):
        assert terms(doc_id) == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(scanned).collect()}
    assert "arquon" not in clean[3] and "[email]" in clean[3]
    assert "Bra*" in clean[7] and "[ip]" in clean[7] and "Brantorium" not in clean[7]
    assert clean[600] == "Zarquon alone" and clean[601] is None


def test_no_python_in_the_plan(spark):
    plan = pii.scan(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_contexts_go_on_past_matches_that_are_dropped(spark):
    far = "x" * 130
    text = f"Anna of 12 and 34 pays by 4111 1111 1111 1111 for 56 to Zoe {far} no"
    # 999.1.1.1 is no address, so words before it are within the context of the one that is.
    rows = [(1, text), (2, "Otto 999.1.1.1 at 10.0.0.1, 10.0.0.2 Ida")]
    found = {
        r["doc_id"]: r["found"]
        for r in pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert [f["context"] for f in found[1] if f["kind"] == "card"] == ["Anna of 12 and 34 pays by   for 56 to Zoe "]
    assert [f["context"] for f in found[2] if f["kind"] == "ip"] == ["Otto 999.1.1.1 at  , ", ",   Ida"]
