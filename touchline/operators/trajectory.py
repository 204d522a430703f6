"""Trajectory operators: cadence, frame ids, steps, smoothing, kinematics, snippets.

All of them work on series ``keys`` ordered by an integer ``order`` column and use the
chunked building blocks of :mod:`touchline.operators.series`, so one long series never
becomes one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline import constants as K
from touchline.functions import scalars as S
from touchline.operators.series import (
    DEFAULT_ROWS,
    DEFAULT_SPAN,
    POS,
    LentChunks,
    last_seen,
    lend_borders,
    open_series,
    rank_distinct,
    row_positions,
    running_totals,
)
from touchline.operators.smoothing import odd, smooth_columns

TRACK_KEYS = ("match_id", "player_id", "period")


def keep_pattern(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    modulus: int = 5,
    offsets: Sequence[int] = (0, 2),
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Thin a regular clock: keep frames whose rank mod ``modulus`` is in ``offsets``.

    With the defaults 25 Hz becomes 10 Hz. Ranks run over the distinct frames of each
    key; the kept rows gain ``kept_idx``, their index among the kept frames.
    """
    ranked = rank_distinct(df, keys, order, name="_rank", span=span)
    phase = F.pmod("_rank", F.lit(modulus))
    per_cycle = {o: i for i, o in enumerate(sorted(offsets))}
    index = F.floor(F.col("_rank") / modulus) * len(per_cycle) + S.lookup(phase.cast("int"), per_cycle)
    kept = ranked.filter(phase.isin(*offsets)).select(*keys, order, index.cast("long").alias("kept_idx"))
    return df.join(kept, [*keys, order])


def step_distance(
    df: DataFrame,
    keys: Sequence[str],
    *,
    x: str = "x",
    y: str = "y",
    index: str = "kept_idx",
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Distance from the previous kept frame, null when that frame is missing."""
    chunks = open_series(df, keys, index, before=1, span=span, rows=rows)
    w = chunks.window()
    follows = F.col(index) - F.lag(index).over(w) == 1
    moved = S.distance(F.col(x), F.col(y), F.lag(x).over(w), F.lag(y).over(w))
    return chunks.with_df(
        chunks.df.withColumn("distance_m", F.when(follows, F.round(moved, 3)))
    ).close()


def step_speed_with_reset(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    x: str = "x",
    y: str = "y",
    visible: str = "is_visible",
    dt: float = 0.1,
    round_to: int | None = 3,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Distance and speed since the last usable position.

    A hidden row clears the memory; a visible row without coordinates leaves it alone.
    """
    here = F.coalesce(F.col(visible), F.lit(False))
    placed = here & F.col(x).isNotNull() & F.col(y).isNotNull()
    memory = F.when(placed, F.struct(F.lit(True).alias("set"), F.col(x).alias("px"), F.col(y).alias("py"))).when(
        ~here,
        F.struct(
            F.lit(False).alias("set"),
            F.lit(None).cast("double").alias("px"),
            F.lit(None).cast("double").alias("py"),
        ),
    )
    out = last_seen(df, keys, order, memory, "_memory", inclusive=False, span=span)
    gap = S.distance(F.col(x), F.col(y), F.col("_memory.px"), F.col("_memory.py"))
    known = placed & F.coalesce(F.col("_memory.set"), F.lit(False))

    def tidy(value: Column) -> Column:
        return value if round_to is None else F.round(value, round_to)

    return (
        out.withColumn("_gap", F.when(known, gap))
        .withColumn("distance_m", tidy(F.col("_gap")))
        .withColumn("speed_kmh", tidy(F.col("_gap") / F.lit(dt) * 3.6))
        .drop("_gap", "_memory")
    )


def playing_order(period: str = "period", frame: str = "frame_id_source") -> Column:
    """One sortable number for (period, source frame); unknown periods come first."""
    rank = S.lookup(F.col(period), {"first_half": 0, "second_half": 1}, F.lit(-1))
    return (rank * K.PERIOD_SORT_STRIDE + F.coalesce(F.col(frame), F.lit(0))).cast("long")


def dense_frame_id(
    df: DataFrame,
    *,
    match: str = "match_id",
    period: str = "period",
    frame: str = "frame_id_source",
    name: str = "frame_id",
    frames: DataFrame | None = None,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Frame ids 0, 1, 2, ... per match in playing order; ranks distinct frames only.

    ``frames`` may name a cheaper table holding the same frames (say, the raw scan when
    ``df`` is an expensive plan), so ``df`` is evaluated once.
    """
    order = playing_order(period, frame)
    listed = (df if frames is None else frames).select(match, order.alias("_order"))
    ranks = rank_distinct(listed, [match], "_order", name=name, span=span)
    return df.withColumn("_order", order).join(ranks, [match, "_order"]).drop("_order")


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    starts_run: Column | None = None,
    *,
    value: str | None = None,
    name: str = "run_id",
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Number contiguous runs of rows.

    Without ``value`` a row starts a run where ``starts_run`` holds. With ``value`` runs
    are the stretches of non-null values, and rows without a value get no run.
    """
    if value is not None:
        chunks = open_series(df, keys, order, before=1, span=span, rows=rows)
        here = F.col(value).isNotNull()
        before = F.lag(here.cast("int")).over(chunks.window())
        flagged = chunks.with_df(
            chunks.df.withColumn("_starts", here & (F.coalesce(before, F.lit(0)) == 0))
        ).close()
        out = running_totals(flagged, keys, order, {name: F.col("_starts").cast("long")}, span=span)
        return out.withColumn(name, F.when(here, F.col(name))).drop("_starts")
    return running_totals(df, keys, order, {name: starts_run.cast("long")}, span=span)


def savgol(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    column: str,
    *,
    width: int = 5,
    degree: int = 2,
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Add ``{column}_filtered``, smoothed over each run of non-null values."""
    chunks = open_series(df, keys, order, before=width - 1, after=width - 1, span=span, rows=rows)
    return smooth_columns(chunks, {column: f"{column}_filtered"}, width=width, degree=degree).close()


def _smooth_positions(
    chunks: LentChunks,
    windows: Mapping[str, int],
    *,
    x: str,
    y: str,
    exclude: Column,
    source: str,
    degree: int,
) -> LentChunks:
    """Smooth x, y of the sources in ``windows``; needs ``_n_rows``, ``_n_valid_x/_y``."""
    df = chunks.df.withColumns(
        {
            "_exclude": F.coalesce(exclude, F.lit(False)),
            "x_smooth": F.col(x).cast("double"),
            "y_smooth": F.col(y).cast("double"),
        }
    )
    for name, width in windows.items():
        width = odd(width)
        applies = (F.col(source) == name) & (F.col("_n_rows") >= width)
        inputs = {}
        for axis, given in (("x", x), ("y", y)):
            active = applies & (F.col(f"_n_valid_{axis}") > 0)
            inputs[f"_clean_{axis}"] = F.when(active & ~F.col("_exclude"), F.col(given))
            inputs[f"_active_{axis}"] = active
        smoothed = smooth_columns(
            chunks.with_df(df.withColumns(inputs)),
            {"_clean_x": "_fit_x", "_clean_y": "_fit_y"},
            width=width,
            degree=degree,
        ).df
        df = smoothed.withColumns(
            {
                f"{axis}_smooth": F.when(F.col(f"_active_{axis}"), F.col(f"_fit_{axis}")).otherwise(
                    F.col(f"{axis}_smooth")
                )
                for axis in ("x", "y")
            }
        ).drop("_clean_x", "_clean_y", "_active_x", "_active_y", "_fit_x", "_fit_y")
    return chunks.with_df(df.drop("_exclude"))


def _validity_totals(x: str, y: str, exclude: Column) -> dict[str, Column]:
    usable = ~F.coalesce(exclude, F.lit(False))
    return {
        "_n_rows": F.lit(1),
        "_n_valid_x": (usable & F.col(x).isNotNull()).cast("long"),
        "_n_valid_y": (usable & F.col(y).isNotNull()).cast("long"),
    }


def smooth_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    windows: Mapping[str, int] | None = None,
    x: str = "x",
    y: str = "y",
    exclude: Column | None = None,
    source: str = "source",
    degree: int = K.SMOOTHING_ORDER,
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Add ``x_smooth``, ``y_smooth``: window per source, excluded rows act as gaps.

    Sources without a window keep raw positions. So does a series that has fewer rows
    than the window, or no usable row at all.
    """
    windows = K.SMOOTHING_WINDOW if windows is None else windows
    exclude = F.lit(False) if exclude is None else exclude
    reach = max([odd(w) for w in windows.values()], default=1) - 1
    chunks = open_series(
        df, keys, order, before=reach, after=reach,
        group_totals=_validity_totals(x, y, exclude), span=span, rows=rows,
    )
    done = _smooth_positions(chunks, windows, x=x, y=y, exclude=exclude, source=source, degree=degree)
    return done.close().drop("_n_rows", "_n_valid_x", "_n_valid_y")


def _speed(chunks: LentChunks, *, x: str, y: str, seconds: str) -> Column:
    w = chunks.window()
    moved = S.distance(F.col(x), F.col(y), F.lag(x).over(w), F.lag(y).over(w))
    return F.try_divide(moved, F.col(seconds) - F.lag(seconds).over(w)) * 3.6


def _acceleration(chunks: LentChunks, *, speed: str, seconds: str) -> Column:
    """Speed difference over the mean of the last two time steps, in m/s^2."""
    w = chunks.window()
    change = (F.col(speed) - F.lag(speed).over(w)) / 3.6
    mean_step = (F.col(seconds) - F.lag(seconds, 2).over(w)) / 2
    return F.try_divide(change, mean_step)


def derive_speed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    x: str = "x_smooth",
    y: str = "y_smooth",
    seconds: str = "t_s",
    name: str = "speed_kmh_filtered",
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Speed in km/h from consecutive positions and their actual time step."""
    chunks = open_series(df, keys, order, before=1, span=span, rows=rows)
    return chunks.with_df(chunks.df.withColumn(name, _speed(chunks, x=x, y=y, seconds=seconds))).close()


def derive_acceleration(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    speed: str = "speed_kmh_filtered",
    seconds: str = "t_s",
    name: str = "acceleration_ms2",
    width: int = K.ACCEL_WINDOW,
    degree: int = K.SMOOTHING_ORDER,
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Acceleration from speed, and its smoothed variant ``{name}_filtered``."""
    reach = width - 1
    chunks = open_series(df, keys, order, before=reach + 2, after=reach, span=span, rows=rows)
    raw = chunks.with_df(chunks.df.withColumn(name, _acceleration(chunks, speed=speed, seconds=seconds)))
    return smooth_columns(raw, {name: f"{name}_filtered"}, width=width, degree=degree).close()


def kinematics_qc(
    df: DataFrame,
    *,
    keys: Sequence[str] = TRACK_KEYS,
    order: str = "frame_id_source",
    seconds: str = "t_s",
    windows: Mapping[str, int] | None = None,
    masked_sources: Sequence[str] = (K.SOURCE_JSON,),
    max_speed: float = K.MAX_SPEED_KMH,
    max_accel: float = K.MAX_ACCEL_MS2,
    round_to: int | None = 3,
    direction: str | None = "play_direction",
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Kinematics and quality control of all matches in one plan.

    Sources listed in ``windows`` get smoothed positions, derived speed and derived
    acceleration; the others keep their native values. Then, in this order: hidden rows
    of ``masked_sources`` lose their kinematics, magnitudes over the limits become null,
    acceleration needs a speed, floats are rounded, and x is mirrored where the home
    side attacked right to left. All series work shares one exchange and one sort.
    """
    windows = dict(K.SMOOTHING_WINDOW if windows is None else windows)
    derived = F.col("source").isin(*windows) if windows else F.lit(False)
    spike = F.abs("speed_kmh") > max_speed
    pos_reach = max([odd(w) for w in windows.values()], default=1) - 1
    acc_reach = K.ACCEL_WINDOW - 1
    chunks = open_series(
        df, keys, order,
        before=pos_reach + acc_reach + 2, after=pos_reach + acc_reach,
        group_totals=_validity_totals("x", "y", spike), span=span, rows=rows,
    )
    chunks = _smooth_positions(
        chunks, windows, x="x", y="y", exclude=spike, source="source", degree=K.SMOOTHING_ORDER
    )
    native_speed = S.cap(F.col("speed_kmh"), max_speed)
    native_accel = S.cap(F.col("acceleration_ms2"), max_accel)
    moving = F.when(derived, _speed(chunks, x="x_smooth", y="y_smooth", seconds=seconds))
    chunks = chunks.with_df(
        chunks.df.withColumns(
            {
                "speed_kmh_filtered": F.when(derived, moving).otherwise(native_speed),
                "speed_kmh": native_speed,
            }
        )
    )
    change = _acceleration(chunks, speed="speed_kmh_filtered", seconds=seconds)
    chunks = chunks.with_df(chunks.df.withColumn("_derived_accel", F.when(derived, change)))
    chunks = smooth_columns(
        chunks, {"_derived_accel": "_smooth_accel"}, width=K.ACCEL_WINDOW, degree=K.SMOOTHING_ORDER
    )
    out = chunks.close()
    hidden = F.col("source").isin(*masked_sources) & ~F.coalesce("is_visible", F.lit(False))

    def shown(value: Column) -> Column:
        return F.when(~hidden, value)

    speed = S.cap(shown(F.col("speed_kmh_filtered")), max_speed)

    def with_speed(value: Column) -> Column:
        return F.when(speed.isNotNull(), S.cap(shown(value), max_accel))

    final = {
        "speed_kmh": shown(F.col("speed_kmh")),
        "speed_kmh_filtered": speed,
        "acceleration_ms2": with_speed(
            F.when(derived, F.col("_derived_accel")).otherwise(native_accel)
        ),
        "acceleration_ms2_filtered": with_speed(
            F.when(derived, F.col("_smooth_accel")).otherwise(native_accel)
        ),
    }
    for name in ("distance_m",):
        if name in out.columns:
            final[name] = shown(F.col(name))
    for name in ("x", "y", "ball_x", "ball_y", "ball_z"):
        if name in out.columns:
            final[name] = F.col(name)
    for name in final:
        if round_to is not None:
            final[name] = F.round(final[name], round_to)
        if direction and direction in out.columns and name in ("x", "ball_x"):
            final[name] = S.flip_if(final[name], F.col(direction))
    out = out.withColumns(final)
    return out.drop(
        "x_smooth", "y_smooth", "_derived_accel", "_smooth_accel", "_n_rows", "_n_valid_x", "_n_valid_y"
    )


def raw_view_decimated(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    x: str = "x",
    y: str = "y",
    seconds: str = "t_s",
    modulus: int = 5,
    offsets: Sequence[int] = (0, 2),
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Minimal kinematics after thinning every series by its own row position.

    Rows without coordinates are skipped; distance, speed and acceleration use the
    actual time since the previous remaining row.
    """
    placed = row_positions(df, keys, order, name="_own", span=span)
    thinned = placed.filter(
        F.pmod("_own", F.lit(modulus)).isin(*offsets) & F.col(x).isNotNull() & F.col(y).isNotNull()
    ).drop("_own")
    return _plain_kinematics(thinned, keys, order, x=x, y=y, seconds=seconds, span=span, rows=rows)


def raw_view_with_resets(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    x: str = "x",
    y: str = "y",
    visible: str = "is_visible",
    seconds: str = "t_s",
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Minimal kinematics that start afresh after every hidden row."""
    hidden = (~F.coalesce(F.col(visible), F.lit(False))).cast("long")
    staged = running_totals(df, keys, order, {"_reset": hidden}, span=span)
    shown = staged.filter(
        F.coalesce(F.col(visible), F.lit(False)) & F.col(x).isNotNull() & F.col(y).isNotNull()
    )
    return _plain_kinematics(
        shown, keys, order, x=x, y=y, seconds=seconds, era="_reset", span=span, rows=rows
    ).drop("_reset")


def _plain_kinematics(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    x: str,
    y: str,
    seconds: str,
    era: str | None = None,
    span: int,
    rows: int,
) -> DataFrame:
    """Distance, speed, acceleration between neighbours of the same era.

    The speed memory survives any number of steps without positive duration: acceleration
    compares with the last speed that exists in the era.
    """
    chunks = open_series(df, keys, order, before=1, span=span, rows=rows)
    w = chunks.window()
    same = F.lit(True) if era is None else F.col(era) == F.lag(era).over(w)
    dt = F.col(seconds) - F.lag(seconds).over(w)
    out = chunks.df.withColumn("_dt", F.when(same & (dt > 0), dt))
    moved = S.distance(F.col(x), F.col(y), F.lag(x).over(w), F.lag(y).over(w))
    out = out.withColumn("distance_m", F.when(F.col("_dt").isNotNull(), moved))
    out = out.withColumn("_ms", F.col("distance_m") / F.col("_dt"))
    moved_rows = chunks.with_df(out.withColumn("speed_kmh", F.col("_ms") * 3.6)).close()
    series = list(keys) if era is None else [*keys, era]
    remembered = last_seen(moved_rows, series, order, F.col("_ms"), "_last_ms", inclusive=False, span=span)
    gained = (F.col("_ms") - F.col("_last_ms")) / F.col("_dt")
    return remembered.withColumn("acceleration_ms2", gained).drop("_dt", "_ms", "_last_ms")


def visible_segments(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    visible: str = "is_visible",
    min_rows: int = 50,
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Visible rows that lie in an unbroken visible stretch of at least ``min_rows`` rows.

    A row qualifies exactly when ``min_rows - 1`` rows of context on either side suffice
    to find such a stretch around it, so no stretch is ever collected.
    """
    reach = min_rows - 1
    chunks = open_series(df, keys, order, before=reach, after=reach, span=span, rows=rows)
    w = chunks.window()
    gap = F.when(~F.coalesce(F.col(visible), F.lit(False)), F.col(POS))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = w.rowsBetween(Window.currentRow, reach)
    first = F.coalesce(F.max(gap).over(upto) + 1, F.min(POS).over(chunks.chunk()))
    last = F.coalesce(
        F.min(gap).over(onward) - 1,
        F.least(F.col(POS) + reach, F.max(POS).over(chunks.chunk())),
    )
    out = chunks.df.withColumn("_stretch", last - first + 1)
    kept = chunks.with_df(out).close()
    return kept.filter(F.col(visible) & (F.col("_stretch") >= min_rows)).drop("_stretch")


def onsets(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    flag: Column,
    *,
    name: str = "starts",
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """1 where ``flag`` holds and did not hold on the previous row."""
    staged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    chunks = open_series(staged, keys, order, before=1, span=span, rows=rows)
    earlier = F.lag("_flag", 1, False).over(chunks.window())
    return chunks.with_df(
        chunks.df.withColumn(name, (F.col("_flag") & ~earlier).cast("int")).drop("_flag")
    ).close()


def snippets(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    features: Sequence[str] = K.SNIPPET_FEATURES,
    *,
    length: int = 50,
    min_segment: int = 50,
    stride: int = 10,
    carry: Sequence[str] = (),
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Overlapping windows of ``length`` consecutive frames, one every ``stride`` frames.

    A segment is a stretch whose ``order`` grows by exactly 1, so ``order`` minus the row
    number is constant in a segment and names it. A window fits exactly when the row
    ``length - 1`` ahead is ``length - 1`` later. Rows need all ``features``. Output:
    keys, ``carry``, ``start_frame``, ``snippet`` (array of structs).
    """
    need = max(length, min_segment)
    ready = df.dropna(subset=[*keys, *features]).select(*dict.fromkeys([*keys, *carry, order, *features]))
    placed = row_positions(ready, keys, order, span=span).withColumn(
        "_segment", F.col(order) - F.col(POS)
    )
    starts = placed.groupBy(*keys, "_segment").agg(
        F.min(order).alias("_start"), F.count(F.lit(1)).alias("_size")
    )
    long_enough = starts.filter(F.col("_size") >= need).drop("_size")
    kept = placed.join(long_enough, [*keys, "_segment"])
    chunks = lend_borders(kept, keys, after=length - 1, rows=rows)
    w = chunks.window()
    frame = F.collect_list(F.struct(*features)).over(w.rowsBetween(0, length - 1))
    out = chunks.df.withColumns({"_end": F.lead(order, length - 1).over(w), "snippet": frame})
    fits = (F.col("_end") - F.col(order) == length - 1) & (
        F.pmod(F.col(order) - F.col("_start"), F.lit(stride)) == 0
    )
    return (
        chunks.with_df(out)
        .close()
        .filter(fits)
        .select(*keys, *carry, F.col(order).alias("start_frame"), "snippet")
    )


def time_steps(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    seconds: str = "t_s",
    name: str = "dt_s",
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Seconds since the previous row of the series."""
    chunks = open_series(df, keys, order, before=1, span=span, rows=rows)
    step = F.col(seconds) - F.lag(seconds).over(chunks.window())
    return chunks.with_df(chunks.df.withColumn(name, step)).close()


def duplicate_number(
    df: DataFrame, keys: Sequence[str], order: str, *, name: str = "copy_no", span: int = DEFAULT_SPAN
) -> DataFrame:
    """0 for the first row of each key, 1 for the second, and so on."""
    return row_positions(df, keys, order, name=name, span=span)
