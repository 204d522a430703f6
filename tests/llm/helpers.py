"""Awkward documents and plain-Python counterparts of the operators."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def document_rows(seed=0, plain=40):
    """Plain texts, near copies, and every awkward case: null, blank, long, repeated, odd."""
    rng = random.Random(seed)
    rows = []
    for i in range(plain):
        text = "\n".join(sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, "en", f"s{i % 3}" if i % 5 else "hot", len(text)))
    base = sentence(rng, 120)
    near = base.split(" ")
    for i in range(8):
        changed = list(near)
        changed[10 * i + 5] = f"Other{i}"
        rows.append((100 + i, " ".join(changed), "en", "hot", 0))
    rows += [(200 + i, base, "en", "hot", 0) for i in range(12)]
    rows += [
        (300, None, None, None, None),
        (301, "", "en", "s1", 0),
        (302, " \t\n\x0b \r\n", "en", "s1", 0),
        (303, "one", "en", None, 3),
        (303, "one", "en", None, 3),
        (303, "another text of the same id", "en", "s2", 3),
        (None, "a text without id, but with words", "en", "s2", 3),
        (304, " ".join(["same"] * 60), "en", "s2", 3),
        (305, "x" * 200_000, "en", "s2", 3),
        (306, " ".join(sentence(rng, 20) for _ in range(2000)), "en", "s2", 3),
        (307, "🙂 漢字 ＡＢ é é    <|endoftext|> don't I'LL 12 345", "en", "s2", 3),
        (308, "\x00 \x1c \x85 nul  two  spaces \n\n lines ", "en", "s2", 3),
    ]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(document_rows() if rows is None else rows, DOCS)
