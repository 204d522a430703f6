"""Savitzky-Golay smoothing over chunked series.

The filter fits a polynomial of degree ``degree`` to ``width`` consecutive values and
reads it at one of them. For a fixed width this is a constant linear map, so a row's
result is a dot product of its neighbours with one row of that map: the middle row
inside a run, another row near either end of the run. The neighbours come from one
bounded window frame; runs shorter than ``width`` stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.operators.series import CHUNK, POS, LentChunks


def odd(width: int) -> int:
    return width if width % 2 else width + 1


def fit_matrix(width: int, degree: int) -> np.ndarray:
    """Row q holds the weights that give the fitted polynomial's value at position q."""
    positions = np.arange(width) - width // 2
    powers = np.vander(positions, degree + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def _literal(value: float) -> str:
    return f"{float(value)!r}D"


def _weight_table(weights: np.ndarray) -> str:
    rows = [f"array({', '.join(_literal(w) for w in row)})" for row in weights]
    return f"array({', '.join(rows)})"


def smooth_columns(
    chunks: LentChunks,
    columns: dict[str, str],
    *,
    width: int,
    degree: int,
    enough_rows: Column | None = None,
) -> LentChunks:
    """Smooth ``columns`` (input name -> output name) over runs of non-null values.

    The chunks must have been opened with at least ``width - 1`` borrowed rows on both
    sides. Where ``enough_rows`` is false the input is copied.
    """
    weights = fit_matrix(width, degree)
    half, reach = width // 2, width - 1
    over = f"partition by {', '.join([*chunks.keys, CHUNK])}"
    ordered = f"{over} order by {POS}"
    table = _weight_table(weights)
    context: dict[str, Column] = {}
    places: dict[str, Column] = {}
    results: dict[str, Column] = {}
    for i, (given, out) in enumerate(columns.items()):
        gap = f"case when {given} is null then {POS} end"
        left, right, place, near, at = (f"_{n}{i}" for n in ("left", "right", "place", "near", "at"))
        first, last = f"min({POS}) over ({over})", f"max({POS}) over ({over})"
        context[left] = F.expr(
            f"{POS} - coalesce(max({gap}) over ({ordered} rows between unbounded preceding and current row) + 1,"
            f" {first})"
        )
        context[right] = F.expr(
            f"coalesce(min({gap}) over ({ordered} rows between current row and {reach} following) - 1,"
            f" least({POS} + {reach}, {last})) - {POS}"
        )
        # All values within reach as one array, and the row's own index in it.
        context[near] = F.expr(
            f"collect_list(coalesce({given}, double('NaN'))) over"
            f" ({ordered} rows between {reach} preceding and {reach} following)"
        )
        context[at] = F.expr(f"cast(least({POS} - {first}, {reach}) as int)")
        places[place] = F.expr(
            f"cast(case when {left} < {half} then {left}"
            f" when {right} < {half} then {reach} - {right} else {half} end as int)"
        )
        # Inside a run the weights are constants; only rows near an end look theirs up.
        inner = " + ".join(
            f"get({near}, {at} + ({o})) * {_literal(weights[half, half + o])}" for o in range(-half, half + 1)
        )
        outer = (
            f"aggregate(zip_with(slice({near}, {at} - {place} + 1, {width}), get({table}, {place}),"
            " (v, w) -> v * w), 0D, (total, term) -> total + term)"
        )
        fitted = F.expr(f"case when {place} = {half} then {inner} else {outer} end")
        usable = F.expr(f"{given} is not null and {left} + {right} + 1 >= {width}")
        if enough_rows is not None:
            usable = usable & enough_rows
        results[out] = F.when(usable, fitted).otherwise(F.col(given))
    kept = [c for c in chunks.df.columns if c not in results]
    df = chunks.df.withColumns(context).withColumns(places)
    return chunks.with_df(df.select(*kept, *[expr.alias(out) for out, expr in results.items()]))
