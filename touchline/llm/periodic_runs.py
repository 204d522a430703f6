"""Runs of periodically repeated words, found through a Re-Pair grammar of each text.

A run is a stretch of words with smallest period q and at least ``least(q)`` words that no
neighbouring word extends. Every text is worked on alone, inside a task:

1. Each word of a run occurs at least four times in it. A word that occurs less often in its
   piece of the text is a border that no run crosses; pieces are cut there, again and again, until
   every word left occurs four times in its piece. Nothing that can be part of a run is lost.
2. Re-Pair over the word numbers of all pieces: the most frequent pair of neighbours becomes a
   nonterminal, until no pair occurs twice. What is left of a piece is joined pairwise.
3. For each nonterminal, once: the runs inside its expansion that cross the border of its two parts.
   A run lies in exactly one lowest node of the derivation, whose border it crosses, so none is missed.
4. These runs are translated to all positions where the nonterminal is derived; of equal periods,
   stretches that lie inside others (cut off by the end of a shorter expansion) are merged into them.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import bound_batches, free_name, slices, with_arrow_columns

BATCH_BYTES = 4 << 20
#: A run has at least SHORTEST words and REPEATS periods.
SHORTEST, REPEATS = 6, 4

Run = tuple[int, int, int]


def _pieces(words: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(start, word numbers) of the stretches in which every word occurs at least REPEATS times."""
    counts = Counter(words)
    number = {}
    for word, count in counts.items():
        number[word] = len(number) if count >= REPEATS else -1
    numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    done: list[tuple[int, np.ndarray]] = []
    waiting = _stretches(numbers, numbers >= 0, 0)
    while waiting:
        start, piece = waiting.pop()
        _, codes, often = np.unique(piece, return_inverse=True, return_counts=True)
        enough = often[codes] >= REPEATS
        if enough.all():
            done.append((start, piece))
        else:
            waiting += _stretches(piece, enough, start)
    return sorted(done, key=lambda found: found[0])


def _stretches(numbers: np.ndarray, inside: np.ndarray, start: int) -> list[tuple[int, np.ndarray]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= SHORTEST
    return [(start + b, numbers[b:e]) for b, e in zip(begins[long].tolist(), ends[long].tolist())]


class Grammar:
    """Re-Pair rules over a list of numbers; negative numbers are borders and never paired."""

    def __init__(self, numbers: list[int]) -> None:
        self.symbols = list(numbers)
        self.first_rule = max(numbers, default=-1) + 1
        self.rules: list[tuple[int, int]] = []
        self._next = list(range(1, len(numbers) + 1))
        self._previous = list(range(-1, len(numbers) - 1))
        self._reduce()

    def _reduce(self) -> None:
        symbols, following = self.symbols, self._next
        places: dict[tuple[int, int], list[int]] = {}
        for at in range(len(symbols) - 1):
            if symbols[at] >= 0 and symbols[at + 1] >= 0:
                places.setdefault((symbols[at], symbols[at + 1]), []).append(at)
        # Counts only fall after a pair is queued, so the stored ones are upper bounds.
        queue = [(-len(found), order, pair) for order, (pair, found) in enumerate(places.items()) if len(found) > 1]
        heapq.heapify(queue)
        order = len(places)
        while queue:
            bound, old, pair = heapq.heappop(queue)
            valid = self._valid(places.pop(pair), pair)
            if len(valid) < 2:
                continue
            if len(valid) < -bound:
                places[pair] = valid
                heapq.heappush(queue, (-len(valid), old, pair))
                continue
            for new, found in self._replace(pair, valid).items():
                if len(found) > 1:
                    places[new] = found
                    heapq.heappush(queue, (-len(found), order, new))
                    order += 1
        at, left, starts = 0, [], []
        while at < len(symbols):
            left.append(symbols[at])
            starts.append(at)
            at = following[at]
        self.symbols, self.starts = left, starts

    def _valid(self, places: list[int], pair: tuple[int, int]) -> list[int]:
        """Places that still hold the pair, without those that overlap the one before."""
        symbols, following = self.symbols, self._next
        first, second = pair
        kept: list[int] = []
        taken = -1
        for at in places:
            after = following[at]
            if symbols[at] == first and after < len(symbols) and symbols[after] == second and at != taken:
                kept.append(at)
                taken = after
        return kept

    def _replace(self, pair: tuple[int, int], places: list[int]) -> dict[tuple[int, int], list[int]]:
        """Put a new nonterminal at the places; the pairs that it forms with its neighbours."""
        symbols, following, previous = self.symbols, self._next, self._previous
        new = self.first_rule + len(self.rules)
        self.rules.append(pair)
        size = len(symbols)
        for at in places:
            gone = following[at]
            after = following[gone]
            symbols[at], symbols[gone] = new, -1
            following[at] = after
            if after < size:
                previous[after] = at
        formed: dict[tuple[int, int], list[int]] = {}
        for at in places:
            before, after = previous[at], following[at]
            if before >= 0 and symbols[before] >= 0 and symbols[before] != new:
                formed.setdefault((symbols[before], new), []).append(before)
            if after < size and symbols[after] >= 0:
                formed.setdefault((new, symbols[after]), []).append(at)
        return formed


def crossing(text: np.ndarray, border: int) -> list[Run]:
    """(start, end, period) of runs of ``text`` that hold words on both sides of ``border``.

    A run with four periods has two of them on one side: that side begins (or ends) at the border with
    a square of the period, and the word beyond the border repeats one period away. Only such periods
    are tried, in ascending order; one whose square lies inside a run already found is no smallest period.
    """
    if len(text) < SHORTEST:
        return []
    found: dict[Run, None] = {}
    for mirrored in (False, True):
        whole = text[::-1] if mirrored else text
        middle = len(text) - border if mirrored else border
        right = whole[middle:]
        most = len(right) // 2
        periods = np.flatnonzero(right[:most] == whole[middle - 1]) + 1
        periods = periods[right[periods] == right[0]]
        covered = 0
        for q in periods.tolist():
            if 2 * q <= covered or not np.array_equal(right[:q], right[q:2 * q]):
                continue
            end = middle + 2 * q + _agreeing(whole[middle + q:-q], whole[middle + 2 * q:])
            start = middle - _agreeing(whole[:middle][::-1], whole[q:middle + q][::-1])
            covered = max(covered, end - middle)
            if end - start >= max(SHORTEST, REPEATS * q):
                found[(len(text) - end, len(text) - start, q) if mirrored else (start, end, q)] = None
    return list(found)


def _agreeing(one: np.ndarray, other: np.ndarray) -> int:
    """Length of the common beginning, looked for in growing steps."""
    most, at, step = min(len(one), len(other)), 0, 64
    while at < most:
        stop = min(most, at + step)
        differing = np.flatnonzero(one[at:stop] != other[at:stop])
        if len(differing):
            return at + int(differing[0])
        at, step = stop, step * 4
    return most


def _runs_of_pieces(pieces: list[tuple[int, np.ndarray]]) -> list[Run]:
    """All runs of the pieces as (start, end, period) in word numbers of the whole text."""
    text: list[int] = []
    homes: list[int] = []
    for start, piece in pieces:
        homes += range(start, start + len(piece))
        text += piece.tolist()
        homes.append(-1)
        text.append(-1)
    grammar = Grammar(text)
    numbers, first = np.array(text, np.int64), grammar.first_rule
    size = [1] * first
    for left, right in grammar.rules:
        size.append(size[left] + size[right])
    # One place of each nonterminal shows its expansion; top nodes join what is left of a piece.
    derived: list[list[int]] = [[] for _ in grammar.rules]
    found: set[Run] = set()
    row: list[tuple[int, int]] = []
    for symbol, at in zip(grammar.symbols, grammar.starts):
        if symbol >= 0:
            row.append((at, size[symbol]))
            if symbol >= first:
                derived[symbol - first].append(at)
            continue
        while len(row) > 1:
            joined = [(a, m + n) for (a, m), (_, n) in zip(row[::2], row[1::2])]
            for (a, m), (_, n) in zip(row[::2], row[1::2]):
                found.update((a + s, a + e, q) for s, e, q in crossing(numbers[a:a + m + n], m))
            row = joined + row[len(joined) * 2:]
        row = []
    # A rule uses older ones only, so from the last to the first all places of a rule are known.
    for rule in range(len(grammar.rules) - 1, -1, -1):
        left, right = grammar.rules[rule]
        places = derived[rule]
        if left >= first:
            derived[left - first] += places
        if right >= first:
            shift = size[left]
            derived[right - first] += [at + shift for at in places]
        derived[rule] = []
        at = places[0]
        for s, e, q in crossing(numbers[at:at + size[first + rule]], size[left]):
            found.update((place + s, place + e, q) for place in places)
    return merge([(homes[s], homes[e - 1] + 1, q) for s, e, q in found])


def merge(found: list[Run]) -> list[Run]:
    """Runs by start, then period; of one period, stretches inside others are dropped."""
    kept: list[Run] = []
    reached: dict[int, int] = {}
    for start, end, q in sorted(found, key=lambda run: (run[2], run[0], -run[1])):
        if end > reached.get(q, -1):
            kept.append((start, end, q))
            reached[q] = end
    return sorted(kept, key=lambda run: (run[0], run[2]))


def find_runs(words: list[bytes]) -> list[Run]:
    """All runs of a list of words as (start, end, period), by start, then period."""
    if len(words) < SHORTEST:
        return []
    pieces = _pieces(words)
    return _runs_of_pieces(pieces) if pieces else []


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    best: Run | None = None
    for run in runs:
        # Runs come by start, then period, so only a greater quotient replaces the best.
        if best is None or (run[1] - run[0]) * best[2] > (best[1] - best[0]) * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """Words joined by one space, without what a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, end, q in runs:
        dropped[start + q] += 1
        dropped[end] -= 1
    keep = np.cumsum(dropped[:-1]) == 0
    return b" ".join([words[at] for at in np.flatnonzero(keep).tolist()])


def repeat_tail(words: list[bytes], begin: int, period: int) -> list[bytes]:
    """Words in which everything from ``begin`` on repeats the ``period`` words that stand there."""
    if begin + period >= len(words):
        return words
    unit = words[begin:begin + period]
    left = len(words) - begin
    return words[:begin] + (unit * (left // period + 1))[:left]


_FIELDS = ("start", "length", "period")
RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in _FIELDS]))
_ARROW_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in _FIELDS]))


def detect(docs: DataFrame, text: str = "text", planted: Column | None = None, keep_text: bool = True) -> DataFrame:
    """Add ``runs`` (start and length in words, period; by start, then period), ``strongest`` (index
    into runs of the one with the most periods, null without runs), ``runs_sha256`` and ``collapsed_sha256``.

    ``planted`` is a number per row (null: none) that makes the text periodic before the search, for
    tests on known repetitions: of n words those from a = planted % n on repeat with period
    1 + floor((n - a) / (3 + planted % 8)).

    Words are separated by ASCII white space only. A null, empty or blank text has no words and no runs.
    The digests are never null: ``start,length,period`` and a line feed for each run, and the
    words that no run repeats, joined by one space. All rows, repeated ones too, keep their own
    result; an empty table gives an empty one. Columns of the added names are replaced; without
    ``keep_text`` the text is left out. A text is worked on as a whole, so a task needs memory for the
    words of its longest text.
    """
    added = ("runs", "strongest", "runs_sha256", "collapsed_sha256")
    bound_batches(docs.sparkSession)
    body = free_name(docs, "run_body")
    seed = free_name(docs, "run_seed")
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")).cast("binary")).withColumn(
        seed, (planted if planted is not None else F.lit(None)).cast("bigint")
    )
    df = df.drop(*(name for name in (*added, *(() if keep_text else (text,))) if name in df.columns))
    dropped = (body, seed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body, BATCH_BYTES):
            rows = []
            for whole, number in zip(batch.column(body).to_pylist(), batch.column(seed).to_pylist()):
                words = whole.split()
                if number is not None and words:
                    begin = number % len(words)
                    words = repeat_tail(words, begin, 1 + (len(words) - begin) // (3 + number % 8))
                runs = find_runs(words)
                best = strongest(runs)
                lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
                rows.append((
                    [{"start": s, "length": e - s, "period": q} for s, e, q in runs],
                    runs.index(best) if best else None,
                    hashlib.sha256(lines.encode()).hexdigest(),
                    hashlib.sha256(collapse(words, runs)).hexdigest(),
                ))
            columns = list(zip(*rows))
            types = (_ARROW_RUNS, pa.int32(), pa.string(), pa.string())
            yield with_arrow_columns(batch, dropped, {n: pa.array(c, t) for n, c, t in zip(added, columns, types)})

    fields = [field for field in df.schema.fields if field.name not in dropped]
    kinds = (RUNS, T.IntegerType(), T.StringType(), T.StringType())
    return df.mapInArrow(search, T.StructType(fields + [T.StructField(n, k) for n, k in zip(added, kinds)]))
