"""Nesting, resume and match-sheet queries over the stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import actions as E
from touchline.operators import audit as D
from touchline.operators.sheets import match_sheets
from touchline.plans.registry import query, r6
from touchline.plans.standin import Tables
from touchline.session import materialise
from touchline.sources import sinks


@query(
    "frame_nest",
    "harm_v",
    """
select match_id, frame_id, count(*) filter (team_id = 'home') as n_home, count(*) filter (team_id <> 'home') as n_away,
  string_agg(player_id, ',' order by player_id) filter (team_id = 'home') as home_ids,
  round(min_by(ball_x, player_id) + 1e-9, 6) as ball_x
from harm_v group by 1, 2
""",
)
def frame_nest(t: Tables) -> DataFrame:
    rows = t.view("harm_v").withColumns(
        {
            "home_team_id": F.lit("home"), "away_team_id": F.lit("away"),
            "timestamp": F.col("t_ms").cast("string"), "position_group": F.lit(None).cast("string"),
        }
    )
    nested = sinks.nest_frames(rows)
    return nested.select(
        "match_id", "frame_id",
        F.size("home").cast("long").alias("n_home"), F.size("away").cast("long").alias("n_away"),
        F.array_join(F.col("home.id"), ",").alias("home_ids"),
        r6("first.ball_x").alias("ball_x"),
    )


@query(
    "event_objects",
    "actions_v",
    """
select event_id, match_id, case action_type when 'pass' then 'pass' when 'throw_in' then 'pass' when 'shot' then 'shot' when 'foul' then 'referee' else 'misc' end as type,
  case action_type when 'throw_in' then 'throw_in' when 'foul' then 'foul' when 'offside' then 'other_ball_action' end as sub_type,
  result = 'success' as is_successful
from actions_v
""",
)
def event_objects(t: Tables) -> DataFrame:
    nothing = F.lit(None).cast("string")
    rows = t.actions().withColumns(
        {c: nothing for c in ("receiver_id", "receiver_time", "body_part", "related_event_ids")}
    ).withColumn("timestamp", F.col("t_ms").cast("string"))
    out = sinks.event_objects(rows)
    return out.select(
        F.col("event.id").alias("event_id"), "match_id", "event.type", "event.sub_type", "event.is_successful"
    )


@query(
    "resume_anti",
    "harm_v",
    """
select distinct match_id, player_id from harm_v h where not exists
  (select 1 from harm_v w where w.match_id = h.match_id and w.player_id = h.player_id and w.event_id % 1000 = 7)
""",
)
def resume_anti(t: Tables) -> DataFrame:
    rows = t.view("harm_v")
    key = ("match_id", "player_id")
    return sinks.pending(rows, rows.filter("event_id % 1000 = 7"), key)


def sheets(t: Tables) -> DataFrame:
    """Match sheets built from the stand-in views."""
    rows = t.view("harm_v").withColumn("timestamp", F.col("t_ms").cast("string"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    matches = rows.groupBy("match_id", "source").agg(F.count(F.lit(1)).alias("n")).select(
        "match_id", "source",
        *[text.alias(c) for c in ("competition", "competition_id", "competition_name", "season_name", "season_id", "kickoff_time_utc", "stadium_id", "stadium_name")],
        *[number.alias(c) for c in ("match_day", "first_half_home", "first_half_away", "second_half_home", "second_half_away", "stadium_capacity")],
        F.lit("home").alias("home_team_id"), F.lit("away").alias("away_team_id"),
        F.pmod(F.col("n"), F.lit(3)).cast("int").alias("home_score"), F.lit(1).alias("away_score"),
        F.lit(105.0).alias("pitch_length"), F.lit(68.0).alias("pitch_width"),
        F.lit("in_stadium").alias("tracking_type"), F.lit("tracker").alias("tracking_name_original"),
        F.lit(25).alias("fps_original"), F.lit(10).alias("fps_output"), F.lit("native").alias("ball_status_source"),
    )
    squads = rows.groupBy("match_id", "team_id", "player_id").agg(
        F.min("event_id").alias("seq"), (F.count_if(F.col("event_id") % 97 == 0) % 3).alias("goals")
    ).select(
        "match_id", "team_id", "player_id", "seq", "goals",
        F.lit(0).cast("long").alias("own_goals"), F.lit(1).cast("long").alias("yellow_cards"), F.lit(0).cast("long").alias("red_cards"),
        *[text.alias(c) for c in ("first_name", "last_name", "player_name", "position_label", "position_group", "end_time")],
        F.col("team_id").alias("team_name"), number.alias("shirt_number"),
        F.lit(True).alias("starting"), F.lit("00:00:00").alias("start_time"),
    )
    officials = matches.filter("match_id <> 'm3'").select(
        "match_id", F.lit("r1").alias("id"), *[text.alias(c) for c in ("first_name", "last_name", "short_name", "official_type")]
    )
    return match_sheets(rows, matches, squads, officials, t.view("directions_v"))


@query(
    "match_sheets",
    "harm_v",
    """
with n as (select match_id, source, count(*) as n from harm_v group by 1, 2),
q as (select match_id, sum(k) as goals from (select match_id, player_id, count(*) filter (event_id % 97 = 0) % 3 as k from harm_v group by 1, 2) p group by 1),
g as (select match_id, count(distinct player_id) filter (team_id = 'home') as n_home,
  count(distinct player_id) filter (team_id = 'away') as n_away, count(distinct player_id) as n_cards, count(distinct period) as n_periods from harm_v group by 1)
select n.match_id, source, case when n % 3 > 1 then 'home' when n % 3 < 1 then 'away' end as winner, cast(goals as int) as n_goals,
  cast(n_cards as int) as n_cards, cast(n_home as int) as n_home, cast(n_away as int) as n_away, cast(n_periods as int) as n_periods,
  cast(n_periods * 2 as int) as n_whistles
from n join g on n.match_id = g.match_id join q on n.match_id = q.match_id
""",
)
def match_sheet_counts(t: Tables) -> DataFrame:
    match = F.col("match")
    return sheets(t).select(
        "match_id", "source",
        match["result"]["winning_team_id"].alias("winner"),
        F.size(match["events"]["goals"]).alias("n_goals"),
        F.size(match["events"]["cards"]).alias("n_cards"),
        F.size(match["teams"]["home"]["players"]).alias("n_home"),
        F.size(match["teams"]["away"]["players"]).alias("n_away"),
        F.size(match["periods"]).alias("n_periods"),
        F.size(match["whistles"]).alias("n_whistles"),
    )


@query(
    "audit_sheets",
    "harm_v",
    """
select match_id, cast(sum(k) as int) as n_goals, true as has_result_final, true as has_events_goals,
  cast(case when match_id = 'm3' then 0 else 1 end as int) as n_referees, match_id <> 'm3' as ids_set,
  true as tracking_has_name, '1.0.0' as format_version, true as compliant
from (select match_id, player_id, count(*) filter (event_id % 97 = 0) % 3 as k from harm_v group by 1, 2) p group by 1
""",
)
def audit_sheets(t: Tables) -> DataFrame:
    written = materialise(sheets(t))
    shape = D.match_sheet_shape(written).select("match_id", "n_goals", "has_result_final", "has_events_goals")
    naming = D.meta_naming(written).select("match_id", "tracking_has_name", "format_version", "compliant")
    return shape.join(D.referees_present(written), "match_id").join(naming, "match_id")


@query(
    "val_native",
    "tracking_v",
    """
select match_id, count(*) as frames_checked, count(*) filter (speed_kmh <> 0) as nonzero_speed,
  count(*) filter (acceleration_ms2 <> 0) as nonzero_accel
from tracking_v group by 1
""",
)
def val_native(t: Tables) -> DataFrame:
    return D.native_kinematics(t.tracking())


@query(
    "substitution_times",
    "actions_v",
    """
with s as (select match_id, seq, (t_ms - 5000) / 1000.0 as el, player_id as i, concat('o', player_id) as o,
    case when event_id % 4 > 0 then action_type end as pos from actions_v where action_type = 'shot'),
e as (select match_id, seq, i as player_id, el as in_s, null::double as out_s, pos from s where el >= 0
  union all select match_id, seq, o, null, el, null from s where el >= 0)
select match_id, player_id, max_by(in_s, seq) filter (in_s is not null) as sub_in_s, max_by(out_s, seq) filter (out_s is not null) as sub_out_s,
  max_by(pos, seq) filter (pos is not null) as in_position from e group by 1, 2
""",
)
def substitution_times(t: Tables) -> DataFrame:
    subs = t.actions().filter("action_type = 'shot'").select(
        "match_id", "seq", ((F.col("t_ms") - 5000) / 1000.0).alias("elapsed_s"),
        F.col("player_id").alias("player_in"), F.concat(F.lit("o"), F.col("player_id")).alias("player_out"),
        F.when(F.col("event_id") % 4 > 0, F.col("action_type")).alias("position"),
    )
    return E.substitution_times(subs)


@query("frame_lines")
def frame_lines(t: Tables) -> DataFrame:
    rows = t.view("harm_v").withColumns(
        {
            "home_team_id": F.lit("home"), "away_team_id": F.lit("away"),
            "timestamp": F.col("t_ms").cast("string"), "position_group": F.lit(None).cast("string"),
        }
    )
    return sinks.frame_lines(sinks.nest_frames(rows))
