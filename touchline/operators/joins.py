"""As-of, interval and in-frame spatial joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators.series import DEFAULT_SPAN, last_seen


def in_latest_interval(
    points: DataFrame,
    intervals: DataFrame,
    *,
    keys: Sequence[str],
    point: str,
    start: str,
    end: str,
    name: str = "inside",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """True when the latest interval starting at or before the point has not ended.

    Only that one interval counts, not any earlier one. Null where the key has no
    intervals. One ordered pass over points and interval starts, no range join.
    """
    starts = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *keys,
        F.col(start).cast("long").alias("_at"),
        F.lit(0).alias("_kind"),
        F.col(end).cast("long").alias("_until"),
    )
    asked = points.select(
        *keys,
        F.col(point).cast("long").alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast("long").alias("_until"),
    ).distinct()
    both = starts.unionByName(asked)
    swept = last_seen(
        both, keys, "_at", F.col("_until"), "_latest", tie=("_kind", "_until"),
        group_totals={"_n": (F.col("_kind") == 0).cast("long")}, span=span,
    )
    verdict = F.when(F.col("_n") > 0, F.coalesce(F.col("_latest") >= F.col("_at"), F.lit(False)))
    answers = swept.filter(F.col("_kind") == 1).select(
        *keys, F.col("_at").alias(point), verdict.alias(name)
    )
    return points.join(answers, [*keys, point], "left")


def nearest_within(
    events: DataFrame,
    frames: DataFrame,
    *,
    keys: Sequence[str],
    event_id: Sequence[str],
    event_time: str,
    frame_time: str,
    tolerance: int,
    carry: Sequence[str],
) -> DataFrame:
    """Nearest frame within ``tolerance`` (same integer unit as the times) per event.

    Ties go to the earlier frame. Times fall into buckets of one tolerance, so an event
    meets only frames of three buckets: an equi-join on (keys, bucket), never a scan of
    a whole key. Events without a frame are dropped. Output: events plus ``carry``.
    """
    cell = F.floor(F.col(event_time) / tolerance)
    asked = events.select(
        *keys,
        *event_id,
        F.col(event_time).alias("_t"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"),
    )
    offered = frames.select(
        *keys,
        F.col(frame_time).alias("_ft"),
        F.floor(F.col(frame_time) / tolerance).alias("_cell"),
        F.struct(*carry).alias("_frame"),
    )
    gap = F.abs(F.col("_ft") - F.col("_t"))
    best = (
        asked.join(offered, [*keys, "_cell"])
        .filter(gap <= tolerance)
        .groupBy(*keys, *event_id)
        .agg(F.min_by("_frame", F.struct(gap, F.col("_ft") > F.col("_t"), "_frame")).alias("_best"))
    )
    picked = best.select(*keys, *event_id, *[F.col(f"_best.{c}").alias(c) for c in carry])
    return events.join(picked, [*keys, *event_id])


def neighbours_in_frame(
    df: DataFrame,
    *,
    frame: Sequence[str] = ("match_id", "frame_id"),
    player: str = "player_id",
    team: str = "team_id",
    x: str = "x",
    y: str = "y",
    near: float = 5.0,
    far: float = 10.0,
    block_rows: int = 64,
) -> DataFrame:
    """Per player and frame: opponents within 5/10 m, teammates within 5 m, minimum distances.

    The players of a frame travel as one array of at most about ``block_rows`` entries.
    A frame with more rows is dealt into several arrays whose partial counts and minima
    are merged, so no array grows with the data.
    """
    seen = df.select(*frame, player, team, x, y)
    crowded = (
        seen.groupBy(*frame)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > block_rows)
        .select(*frame, F.ceil(F.col("_n") / block_rows).alias("_blocks"))
    )
    dealt = seen.join(crowded, list(frame), "left").withColumn(
        "_block", F.pmod(F.xxhash64(player), F.coalesce(F.col("_blocks"), F.lit(1)))
    )
    arrays = dealt.groupBy(*frame, "_block").agg(
        F.collect_list(F.struct(F.col(player).alias("p"), F.col(team).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("_others")
    )
    met = seen.join(arrays, list(frame))

    def gaps(same_team: bool):
        def keep(o):
            side = o["t"].eqNullSafe(F.col(team))
            return (o["p"] != F.col(player)) & (side if same_team else ~side)

        return F.transform(
            F.filter("_others", keep), lambda o: S.distance(F.col(x), F.col(y), o["x"], o["y"])
        )

    met = met.withColumns({"_mates": gaps(True), "_rivals": gaps(False)})
    return met.groupBy(*frame, player).agg(
        F.sum(F.size(F.filter("_rivals", lambda d: d <= near))).alias("opponents_within_5m"),
        F.sum(F.size(F.filter("_rivals", lambda d: d <= far))).alias("opponents_within_10m"),
        F.sum(F.size(F.filter("_mates", lambda d: d <= near))).alias("teammates_within_5m"),
        F.min(F.array_min("_rivals")).alias("min_dist_opponent"),
        F.min(F.array_min("_mates")).alias("min_dist_teammate"),
    )


def with_centroid(
    df: DataFrame,
    *,
    frame: Sequence[str] = ("match_id", "team_id", "frame_id"),
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Add ``rel_x``, ``rel_y``: position relative to the team's mean position in the frame."""
    centre = df.groupBy(*frame).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    return (
        df.join(centre, list(frame), "left")
        .withColumns({"rel_x": F.col(x) - F.col("_cx"), "rel_y": F.col(y) - F.col("_cy")})
        .drop("_cx", "_cy")
    )


def covered_team_frames(
    df: DataFrame,
    *,
    frame: Sequence[str] = ("match_id", "team_id", "frame_id"),
    label: str = "position_label",
    minimum: int = 9,
) -> DataFrame:
    """Rows of team-frames showing at least ``minimum`` outfield players.

    A player without a label counts as an outfield player.
    """
    full = (
        df.filter(~F.col(label).eqNullSafe("GK"))
        .groupBy(*frame)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= minimum)
        .select(*frame)
    )
    return df.join(full, list(frame), "left_semi")


def with_roster(df: DataFrame, roster: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of roster attributes; columns the rows already have are replaced."""
    extra = [c for c in roster.columns if c not in keys]
    return df.drop(*extra).join(roster, list(keys), "left")
