"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics are measured for every whole text. Trees are fitted on a bounded sample of labelled
rows: values are binned once by their quantiles, and each level of a tree is chosen from
histograms of gradients. A fitted model is three arrays over complete binary trees, which
all rows of a batch walk together.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import bound_batches, free_name, slices, with_arrow_columns

BATCH_BYTES = 4 << 20
#: Labelled rows used to fit a model, those of the smallest hashes.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, L2, MIN_WEIGHT = 0.2, 1.0, 5.0
KEEP_FROM = 0.3
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "echoed_words", "distinct_fours", "symbols", "shouts",
    "bars", "capitals", "digits", "stops", "commas", "lines", "wide_bytes", "repeated_lines", "longest_line",
    "ended_lines", "punctuation", "blanks", "controls", "entropy", "longest_word", "brackets",
)


def _class(characters: bytes) -> np.ndarray:
    return np.frombuffer(characters, np.uint8)


_SYMBOLS, _PUNCTUATION = _class(b"#*$%&|<>"), _class(b"!\"'(),-./:;?[]_{}~^@+=`\\")
_BLANKS = _class(b" \t\n\x0b\x0c\r")


def statistics(body: bytes) -> list[float]:
    """The numbers of ``STATISTICS`` for one text in UTF-8; an empty text has finite ones too."""
    bytes_of = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    words = body.split()
    lines = [line for line in body.split(b"\n") if line.strip()]
    size, count, rows = max(len(body), 1), max(len(words), 1), max(len(lines), 1)
    letters = max(int(bytes_of[65:91].sum() + bytes_of[97:123].sum()), 1)
    shares = bytes_of[bytes_of > 0] / size
    fours = max(len(words) - 3, 1)
    return [
        math.log1p(len(body)),
        math.log1p(len(words)),
        (len(body) - int(bytes_of[_BLANKS].sum())) / count,
        len(set(words)) / count,
        sum(map(operator.eq, words, words[1:])) / count,
        len(set(zip(words, words[1:], words[2:], words[3:]))) / fours,
        int(bytes_of[_SYMBOLS].sum()) / size,
        int(bytes_of[33]) / count,
        int(bytes_of[124]) / count,
        int(bytes_of[65:91].sum()) / letters,
        int(bytes_of[48:58].sum()) / size,
        int(bytes_of[46]) / count,
        int(bytes_of[44]) / count,
        len(lines) / count,
        int(bytes_of[128:].sum()) / size,
        1 - len(set(lines)) / rows,
        max(map(len, lines), default=0) / size,
        sum(line.rstrip()[-1:] in b".!?" for line in lines) / rows,
        int(bytes_of[_PUNCTUATION].sum()) / size,
        int(bytes_of[_BLANKS].sum()) / size,
        int(bytes_of[:9].sum() + bytes_of[14:32].sum() + bytes_of[127]) / size,
        float(-(shares * np.log2(shares)).sum()),
        math.log1p(max(map(len, words), default=0)),
        int(bytes_of[60] + bytes_of[62]) / count,
    ]


def measure(docs: DataFrame, text: str = "text", out: str = "statistics", keep_text: bool = True) -> DataFrame:
    """Add the array ``out`` to every row; a null text counts as empty. Nothing is shuffled."""
    bound_batches(docs.sparkSession)
    body = free_name(docs, "measured_body")
    df = docs.drop(*(() if out == text else (out,))).withColumn(body, F.coalesce(F.col(text), F.lit("")).cast("binary"))
    dropped = (body,) if keep_text else (body, text)
    fields = [f for f in df.schema.fields if f.name not in dropped]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body, BATCH_BYTES):
            values = [statistics(whole) for whole in batch.column(body).to_pylist()]
            yield with_arrow_columns(batch, dropped, {out: pa.array(values, pa.list_(pa.float64()))})

    return df.mapInArrow(run, T.StructType(fields + [T.StructField(out, T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Trees:
    """Complete trees: per tree the inner nodes' features and thresholds, and the leaves' values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.base)
        rows = np.arange(len(values))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(values), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                at = 2 * at + 1 + (values[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return total

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(values), -500, 500)))


def fit_trees(
    values: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS
) -> Trees:
    """Boosted trees for 0/1 labels. Without both labels there is no tree, only the smoothed share."""
    rows, width = values.shape if len(values) else (0, len(STATISTICS))
    share = (labels.sum() + 1) / (rows + 2)
    inner, leaves = 2**depth - 1, 2**depth
    base = math.log(share / (1 - share))
    if rows == 0 or labels.min() == labels.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], values[:, f], side="left") for f in range(width)], axis=1)
    features = np.zeros((trees, inner), np.int64)
    thresholds = np.full((trees, inner), np.inf)
    values_of = np.zeros((trees, leaves))
    margin = np.full(rows, base)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, weight = chance - labels, chance * (1 - chance)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            first, number = 2**level - 1, 2**level
            best = np.zeros(number)
            split = np.full((number, 2), -1)
            for f in range(width):
                place = (node - first) * bins + binned[:, f]
                g = np.bincount(place, slope, number * bins).reshape(number, bins).cumsum(axis=1)
                h = np.bincount(place, weight, number * bins).reshape(number, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
                gain[(h < MIN_WEIGHT) | (all_h - h < MIN_WEIGHT)] = 0
                gain[:, len(cuts[f]) :] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(number), cut]
                better = top > best + 1e-12
                best[better] = top[better]
                split[better] = np.stack([np.full(number, f), cut], axis=1)[better]
            right = np.zeros(rows, np.int64)
            for at in range(number):
                f, cut = split[at]
                if f >= 0:
                    features[tree, first + at], thresholds[tree, first + at] = f, cuts[f][cut]
                    here = node == first + at
                    right[here] = binned[here, f] > cut
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, weight, leaves)
        values_of[tree] = -RATE * g / (h + L2)
        margin += values_of[tree][leaf]
    return Trees(base, features, thresholds, values_of)


def fit(
    measured: DataFrame,
    labels: DataFrame,
    trainable: Column | None = None,
    key: str = "doc_id",
    label: str = "quality",
    column: str = "statistics",
    max_rows: int = MAX_TRAINING_ROWS,
) -> Trees:
    """Fit on measured rows with a label, of at most ``max_rows`` documents.

    The sample is bounded; it takes the documents of the smallest hashes. A document's label is
    1 if at least half of its label rows say so; null labels and null keys do not count.
    Of rows that repeat a key, one with the least statistics stands for the document.
    """
    said = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("label_key"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    )
    known = measured if trainable is None else measured.filter(trainable)
    rows = (
        known.groupBy(F.col(key).alias("label_key"))
        .agg(F.min(column).alias("values"))
        .join(said, "label_key")
        .orderBy(F.xxhash64(F.col("label_key").cast("string"), F.lit("fit")), "label_key")
        .limit(max_rows)
        .select("values", "label")
        .collect()
    )
    values = np.array([row["values"] for row in rows], float).reshape(len(rows), len(STATISTICS))
    return fit_trees(values, np.array([row["label"] for row in rows], float))


def score(measured: DataFrame, model: Trees, column: str = "statistics", out: str = "score") -> DataFrame:
    """Replace the statistics by ``out``, the chance that a document is good."""
    df = measured.drop(*(() if out == column else (out,)))
    fields = [f for f in df.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            scores = model.scores(flat.reshape(batch.num_rows, len(STATISTICS)))
            yield with_arrow_columns(batch, (column,), {out: pa.array(scores)})

    return df.mapInArrow(run, T.StructType(fields + [T.StructField(out, T.DoubleType())]))
