"""Nested match sheets assembled from the dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import constants as K
from touchline.functions import scalars as S
from touchline.operators import actions as E


def _nested(df: DataFrame, name: str, order: Column, item: Column) -> DataFrame:
    """Array of ``item`` per match in a given order (periods, players: a handful per match)."""
    listed = F.sort_array(F.collect_list(F.struct(order.alias("_o"), item.alias("_i"))))
    return df.groupBy("match_id").agg(F.transform(listed, lambda s: s["_i"]).alias(name))


def period_rows(tracking: DataFrame, matches: DataFrame, directions: DataFrame) -> DataFrame:
    bounds = E.period_bounds(tracking)
    sides = directions.select("match_id", "period", "play_direction")
    ids = matches.select("match_id", "home_team_id", "away_team_id")
    d = F.col("play_direction")
    return bounds.join(sides, ["match_id", "period"], "left").join(ids, "match_id").withColumns(
        {
            "left_team_id": S.left_team(d, F.col("home_team_id"), F.col("away_team_id")),
            "right_team_id": S.right_team(d, F.col("home_team_id"), F.col("away_team_id")),
        }
    )


def match_sheets(
    tracking: DataFrame, matches: DataFrame, rosters: DataFrame, referees: DataFrame, directions: DataFrame
) -> DataFrame:
    """One nested row per match: match, stadium, periods, whistles, referees, meta."""
    rank = S.lookup(F.col("period"), {p: i for i, p in enumerate(K.PERIODS)}, F.lit(99))
    periods = period_rows(tracking, matches, directions)
    period_item = F.struct(
        F.col("period").alias("type"), "play_direction", "time_start", "time_end", "frame_id_start", "frame_id_end",
        "left_team_id", "right_team_id",
    )
    whistle = E.whistles(E.period_bounds(tracking)).withColumnRenamed("type", "period")
    player = F.struct(
        F.col("player_id").alias("id"), "first_name", "last_name", F.col("player_name").alias("name"), "team_id",
        F.col("shirt_number").alias("jersey_number"), F.col("starting").alias("is_starter"),
        (F.col("starting") | F.col("start_time").isNotNull()).alias("has_played"),
        F.col("position_label").alias("position"), "position_group", "start_time", "end_time",
    )
    sides = matches.select("match_id", "home_team_id", "away_team_id")
    listed = rosters.join(sides, "match_id").withColumns(
        {
            "_home": F.col("team_id") == F.col("home_team_id"),
            "opponent_id": F.when(F.col("team_id") == F.col("home_team_id"), F.col("away_team_id")).otherwise(F.col("home_team_id")),
        }
    )

    def squad(side: str, condition: Column) -> DataFrame:
        team = listed.filter(condition)
        names = team.groupBy("match_id").agg(F.max("team_name").alias(f"{side}_name"))
        return _nested(team, f"{side}_players", F.col("seq"), player).join(names, "match_id")

    entries = E.expand_counts(listed)
    goal = F.struct(
        "player_id", "team_id", (F.col("kind") == "own_goal").alias("is_own_goal"), F.lit(False).alias("is_penalty"),
        F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("assist_id"),
    )
    card = F.struct("player_id", "team_id", F.col("kind").alias("type"), F.lit(None).cast("string").alias("time"))
    sub = F.struct("in_time", "in_player_id", "out_time", "out_player_id", "team_id")
    parts = [
        _nested(periods, "periods", rank, period_item),
        _nested(whistle, "whistles", F.struct(rank, F.when(F.col("sub_type") == "start", 0).otherwise(1)), F.struct(F.col("period").alias("type"), "sub_type", "time")),
        _nested(referees, "referees", F.col("id"), F.struct("id", "first_name", "last_name", "short_name", "official_type")),
        squad("home", F.col("_home")),
        squad("away", ~F.col("_home")),
        _nested(entries.filter(F.col("kind").isin("goal", "own_goal")), "goals", F.struct("team_id", "player_id", "copy_no"), goal),
        _nested(entries.filter(F.col("kind").isin("yellow_card", "red_card")), "cards", F.struct("team_id", "player_id", "copy_no"), card),
        _nested(E.pair_substitutions(listed), "substitutions", F.struct("team_id", "in_time", "in_player_id"), sub),
    ]
    out = matches
    for part in parts:
        out = out.join(part, "match_id", "left")
    won = S.winner(F.col("home_score"), F.col("away_score"), F.col("home_team_id"), F.col("away_team_id"))

    def half(name: str) -> Column:
        return F.struct(F.col(f"{name}_home").alias("home"), F.col(f"{name}_away").alias("away")).alias(name)

    def team(side: str) -> Column:
        return F.struct(
            F.col(f"{side}_team_id").alias("id"), F.col(f"{side}_name").alias("name"),
            F.coalesce(f"{side}_players", F.array()).alias("players"),
        ).alias(side)

    def some(name: str) -> Column:
        return F.coalesce(name, F.array()).alias(name)

    no = F.lit(False)
    vendor = F.col("tracking_name_original")
    match = F.struct(
        F.col("match_id").alias("id"),
        F.struct(F.col("competition_id").alias("id"), F.coalesce("competition_name", "competition").alias("name")).alias("competition"),
        F.struct(F.col("season_id").alias("id"), F.col("season_name").alias("name")).alias("season"),
        "match_day",
        F.col("kickoff_time_utc").alias("kickoff_time"),
        F.col("kickoff_time_utc").alias("scheduled_kickoff_time"),
        F.struct(
            won.alias("winning_team_id"),
            F.struct(F.col("home_score").alias("home"), F.col("away_score").alias("away"), won.alias("winning_team_id")).alias("final"),
            half("first_half"), half("second_half"),
        ).alias("result"),
        F.struct(no.alias("is_neutral"), no.alias("has_extratime"), no.alias("has_shootout")).alias("status"),
        some("periods"), some("whistles"),
        F.struct(team("home"), team("away")).alias("teams"),
        F.struct(some("goals"), some("cards"), some("substitutions")).alias("events"),
    )
    meta = F.struct(
        vendor.alias("vendor"),
        F.struct(F.lit(K.FORMAT_VERSION).alias("version")).alias("format"),
        F.struct(
            vendor.alias("name"), F.col("fps_original").cast("string").alias("version"), F.col("fps_output").alias("fps"),
            F.lit("post_match").alias("collection_timing"), vendor.alias("name_original"), "fps_original", "fps_output",
            "ball_status_source",
        ).alias("tracking"),
        F.struct(vendor.alias("name"), F.lit(None).cast("string").alias("version"), F.lit("post_match").alias("collection_timing")).alias("event"),
        F.struct(F.col("source").alias("domain"), "tracking_type").alias("system"),
        F.struct(F.lit(True).alias("coordinates_normalised")).alias("representation"),
    )
    stadium = F.struct(
        F.col("stadium_id").alias("id"), F.col("stadium_name").alias("name"), F.col("stadium_capacity").alias("capacity"),
        "pitch_length", "pitch_width",
    )
    return out.select(
        "match_id", "source", match.alias("match"), stadium.alias("stadium"), some("periods"), some("whistles"),
        some("referees"), meta.alias("meta"), F.lit(True).alias("coordinates_normalised"),
    )
