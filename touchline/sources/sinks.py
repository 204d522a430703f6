"""Writers: analytical Parquet, frame and event JSON lines, match sheets, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S


def write_tracking(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Parquet by source and match, sorted by frame and player inside each file.

    Range partitioning on (match, frame) lets a large match spread over several tasks.
    """
    spread = df.repartitionByRange("source", "match_id", "frame_id").sortWithinPartitions(
        "source", "match_id", "frame_id", "player_id"
    )
    spread.write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy("source", "match_id").parquet(path)


def _json(mandatory: Column, optional: Column | None = None) -> Column:
    """JSON object that keeps null mandatory keys and drops null optional keys."""
    head = F.to_json(mandatory, {"ignoreNullFields": "false"})
    if optional is None:
        return head
    tail = F.to_json(optional, {"ignoreNullFields": "true"})
    body = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(","), F.substring(tail, 2, F.length(tail)))
    return F.when(tail == "{}", head).otherwise(body)


def nest_frames(df: DataFrame) -> DataFrame:
    """One row per frame: ball of the first row, and home and away players by id.

    Needs ``home_team_id`` and ``away_team_id``. A player whose team is unknown goes by
    ``is_home``.
    """
    home = F.coalesce(F.col("team_id") == F.col("home_team_id"), F.col("is_home"), F.lit(False))
    player = F.struct(
        F.col("player_id").alias("id"), "x", "y",
        F.col("position_label").alias("position"), "position_group", "is_visible",
        S.kmh_to_ms(F.col("speed_kmh_filtered")).alias("vel"),
        F.col("acceleration_ms2_filtered").alias("acc"), F.col("distance_m").alias("dist"),
    )
    frame = F.struct("timestamp", "period", "ball_x", "ball_y", "ball_z", "ball_status", "ball_poss_team_id")
    return df.groupBy("match_id", "frame_id", "home_team_id", "away_team_id").agg(
        F.min_by(frame, "player_id").alias("first"),
        F.sort_array(F.collect_list(F.when(home, player))).alias("home"),
        F.sort_array(F.collect_list(F.when(~home, player))).alias("away"),
    )


def frame_lines(nested: DataFrame) -> DataFrame:
    """JSON text of each nested frame as (match_id, frame_id, value)."""
    def players(side: str) -> Column:
        texts = F.transform(
            side,
            lambda p: _json(
                F.struct(p["id"].alias("id"), p["x"].alias("x"), p["y"].alias("y")),
                F.struct(*[p[c].alias(c) for c in ("position", "position_group", "is_visible", "vel", "acc", "dist")]),
            ),
        )
        return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))

    def quoted(value: Column) -> Column:
        return F.coalesce(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2), F.lit("null"))

    ball = _json(
        F.struct(F.lit("ball").alias("id"), *[F.col(f"first.ball_{c}").alias(c) for c in ("x", "y", "z")]),
        F.struct(F.col("first.ball_status").alias("status"), F.col("first.ball_poss_team_id").alias("poss_team_id")),
    )
    head = F.to_json(
        F.struct("frame_id", "first.timestamp", "first.period", F.struct(F.col("match_id").alias("id")).alias("match")),
        {"ignoreNullFields": "false"},
    )

    def team(side: str) -> Column:
        return F.concat(F.lit('{"id":'), quoted(F.col(f"{side}_team_id")), F.lit(',"players":'), players(side), F.lit("}"))

    value = F.concat(
        F.substring(head, 1, F.length(head) - 1), F.lit(',"ball":'), ball,
        F.lit(',"teams":{"home":'), team("home"), F.lit(',"away":'), team("away"), F.lit("}}"),
    )
    return nested.select("match_id", "frame_id", value.alias("value"))


def write_frame_lines(lines: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    spread = lines.repartitionByRange("match_id", "frame_id").sortWithinPartitions("match_id", "frame_id")
    spread.select("match_id", "value").write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(
        "match_id"
    ).text(path)


def event_objects(actions: DataFrame) -> DataFrame:
    """Nested event of each action, with explicit nulls when rendered as JSON."""
    action, result = F.col("action_type"), F.col("result")
    event = F.struct(
        F.col("event_id").alias("id"), F.col("timestamp").alias("time"), "period",
        S.event_type(action).alias("type"), S.event_sub_type(action).alias("sub_type"),
        S.success_flag(result).alias("is_successful"), S.outcome_type(action, result).alias("outcome_type"),
        "player_id", "team_id", "receiver_id", "receiver_time",
        F.col("start_x").alias("x"), F.col("start_y").alias("y"), F.col("end_x").alias("x_end"), F.col("end_y").alias("y_end"),
        "body_part", "related_event_ids",
    )
    return actions.select(
        "match_id",
        F.struct(F.col("match_id").alias("id")).alias("match"),
        F.struct(F.lit(True).alias("is_synced")).alias("meta"),
        event.alias("event"),
    )


def event_lines(actions: DataFrame) -> DataFrame:
    return event_objects(actions).select(
        "match_id", _json(F.struct("match", "meta", "event")).alias("value")
    )


def write_actions(actions: DataFrame, path: str, lines_path: str | None = None, *, mode: str = "overwrite") -> None:
    """Parquet by match, and optionally one JSON line per event."""
    by_match = actions.repartitionByRange("match_id", "timestamp").sortWithinPartitions("match_id", "timestamp")
    by_match.write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy("match_id").parquet(path)
    if lines_path:
        event_lines(by_match).write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy("match_id").text(
            lines_path
        )


def write_sheets(sheets: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """JSON by source and match; only the partitions of the given matches are replaced."""
    sheets.write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy("source", "match_id").json(path)


def pending(discovered: DataFrame, written: DataFrame | None, key: Sequence[str] = ("match_id",)) -> DataFrame:
    """Discovered keys that have no output yet."""
    keys = discovered.select(*key).distinct()
    return keys if written is None else keys.join(written.select(*key).distinct(), list(key), "left_anti")


def write_report(sections: dict[str, DataFrame], path: str, *, mode: str = "overwrite") -> None:
    """One JSON table per report section."""
    for name, section in sections.items():
        section.write.mode(mode).json(f"{path}/{name}")

