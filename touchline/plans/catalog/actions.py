"""Scalar expressions and action operators over the stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import constants as K
from touchline.functions import scalars as S
from touchline.operators import actions as E
from touchline.plans.registry import query, r6, rounded
from touchline.plans.standin import Tables
from touchline.session import materialise


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Scalars -------------------------------------------------------------------------------

_CLOCK_PARTS = """
parts as (select event_id, lpad(cast(event_id % 24 as {s}), 2, '0') as hh,
  lpad(cast(event_id % 60 as {s}), 2, '0') as mm, lpad(cast(event_id % 53 as {s}), 2, '0') as ss from stream_v),
raws as (select event_id, case event_id % 6
    when 0 then concat('2024-01-05T', hh, ':', mm, ':', ss, 'Z')
    when 1 then concat('2024-01-05T', hh, ':', mm, ':', ss, '.250000+02:00')
    when 2 then concat('2024-01-05T', hh, ':', mm, ':', ss)
    when 3 then 'not a time' when 4 then '' else null end as raw,
  case event_id % 5 when 0 then concat(hh, ':', mm, ':', ss, '.5') when 1 then concat(mm, ':', ss, '.25')
    when 2 then 'x:y:z' when 3 then null else concat(hh, ':', mm, ':', ss) end as clock from parts)
"""


def _raws(t: Tables) -> DataFrame:
    return t.sql("stream_v", f"with {_CLOCK_PARTS.format(s='string').strip()} select * from raws")


_ANSI_RAWS = _CLOCK_PARTS.format(s="varchar").strip()


@query(
    "iso_norm",
    "stream_v",
    f"""
with {_ANSI_RAWS}
select event_id, case when raw is null or raw = '' then null when utc is null then raw
  else concat(strftime(utc, '%Y-%m-%dT%H:%M:%S'),
    case when microsecond(utc) % 1000000 <> 0
      then concat('.', lpad(cast(microsecond(utc) % 1000000 as varchar), 6, '0')) else '' end, '+00:00')
  end as iso from (select *, try_cast(replace(replace(raw, '+02:00', ''), 'Z', '') as timestamp)
    - case when raw like '%+02:00' then interval 2 hour else interval 0 hour end as utc from raws) q
""",
)
def iso_norm(t: Tables) -> DataFrame:
    return _raws(t).select("event_id", S.iso_normalise(F.col("raw")).alias("iso"))


_CLOCK_SQL = """
case when clock is null then 0.0
  when len(string_split(clock, ':')) = 3 then coalesce(try_cast(string_split(clock, ':')[1] as int) * 3600
    + try_cast(string_split(clock, ':')[2] as int) * 60 + try_cast(string_split(clock, ':')[3] as double), 0.0)
  when len(string_split(clock, ':')) = 2 then coalesce(try_cast(string_split(clock, ':')[1] as int) * 60
    + try_cast(string_split(clock, ':')[2] as double), 0.0) else 0.0 end
"""


@query("clock_secs", "stream_v", f"with {_ANSI_RAWS} select event_id, {_CLOCK_SQL.strip()} as secs from raws")
def clock_secs(t: Tables) -> DataFrame:
    return _raws(t).select("event_id", S.clock_seconds(F.col("clock")).alias("secs"))


@query(
    "derived_utc",
    "stream_v",
    f"""
with {_ANSI_RAWS},
c as (select event_id, {_CLOCK_SQL.strip()} as secs, case when event_id % 2 = 0 then 0.0 else 2790.0 + 900.0 end as off from raws)
select event_id, epoch_us(timestamp '2024-01-05 12:00:00') + cast((off + secs) * 1000000 as bigint) as utc_us from c
""",
)
def derived_utc(t: Tables) -> DataFrame:
    offset = F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(2790.0 + K.HALF_TIME_BREAK_SECONDS)
    at = S.shift_seconds(
        S.to_utc(F.lit("2024-01-05T12:00:00+00:00")), offset + S.clock_seconds(F.col("clock"))
    )
    return _raws(t).select("event_id", F.unix_micros(at).alias("utc_us"))


@query(
    "hms",
    "stream_v",
    """
select event_id, case when value - 20 >= 0 then
  concat(lpad(cast(cast(floor(floor((value - 20) * 100) / 3600) as bigint) as varchar), 2, '0'), ':',
         lpad(cast(cast(floor((cast(floor((value - 20) * 100) as bigint) % 3600) / 60) as bigint) as varchar), 2, '0'), ':',
         lpad(cast(cast(floor((value - 20) * 100) as bigint) % 60 as varchar), 2, '0')) end as clock
from stream_v
""",
)
def hms(t: Tables) -> DataFrame:
    return t.view("stream_v").select(
        "event_id", S.hms((F.col("value") - 20) * 100).alias("clock")
    )


@query(
    "scalar_codes",
    "actions_v",
    """
select event_id,
  cast(case when event_id % 2 = 1 then 45 else 0 end + floor(start_x * 10 / 60) + 1 as int) as match_minute,
  round(start_x - 52.5 + 1e-9, 6) as centred_x,
  round(start_x / 3.6 + 1e-9, 3) as speed_ms,
  case when event_id % 7 > event_id % 5 then 'home' when event_id % 5 > event_id % 7 then 'away' end as winner,
  case when event_id % 3 = 0 then 'home' when event_id % 3 = 1 then 'away' end as left_team,
  case when event_id % 3 = 0 then 'away' when event_id % 3 = 1 then 'home' end as right_team,
  case when event_id % 4 = 1 then 'home' when event_id % 4 = 2 then 'away' end as ball_team,
  coalesce(case when event_id % 2 = 0 then team_id end,
    case when event_id % 6 = 1 then 'home' when event_id % 6 = 3 then 'away' end) as ball_team_named,
  case when event_id % 3 = 0 then 'A' when event_id % 3 = 1 then 'B' else 'other' end as source_name,
  case when event_id % 11 = 0 then null else round(start_x + 1e-9, 3) end as finite_x
from actions_v
""",
)
def scalar_codes(t: Tables) -> DataFrame:
    e = F.col("event_id")
    home, away = F.lit("home"), F.lit("away")
    direction = F.when(e % 3 == 0, "left_right").when(e % 3 == 1, "right_left")
    raw_source = F.when(e % 3 == 0, "a").when(e % 3 == 1, "B").otherwise("other")
    wild = F.when(e % 11 == 0, F.lit(float("inf"))).otherwise(F.col("start_x"))
    group = F.when(e % 6 == 1, "home team").when(e % 6 == 3, "away team")
    return t.actions().select(
        "event_id",
        S.match_minute(F.col("start_x") * 10, (e % 2 + 1)).alias("match_minute"),
        r6(S.recentre(F.col("start_x"), K.DEFAULT_PITCH_LENGTH)).alias("centred_x"),
        S.kmh_to_ms(F.col("start_x") + 3.6e-9).alias("speed_ms"),
        S.winner(e % 7, e % 5, home, away).alias("winner"),
        S.left_team(direction, home, away).alias("left_team"),
        S.right_team(direction, home, away).alias("right_team"),
        S.possession_by_code(e % 4, home, away).alias("ball_team"),
        S.possession_by_group(F.when(e % 2 == 0, F.col("team_id")), group, home, away).alias("ball_team_named"),
        S.canonical_source(raw_source, ("A", "B")).alias("source_name"),
        F.round(S.finite(wild) + 1e-9, 3).alias("finite_x"),
    )


@query(
    "orient_flip",
    "tracking_v directions_v",
    """
select t.event_id, round(case when play_direction = 'right_left' then -x else x end + 1e-9, 6) as x
from tracking_v t left join directions_v d on t.match_id = d.match_id and t.period = d.period and t.source = d.source
""",
)
def orient_flip(t: Tables) -> DataFrame:
    from touchline.operators.features import oriented

    directions = t.view("directions_v").select("match_id", "period", "play_direction").distinct()
    return oriented(t.tracking(), directions).select("event_id", r6("x").alias("x"))


@query(
    "play_direction",
    "actions_v",
    """
with k as (select match_id, period, event_id, case when event_id % 13 < 7 then 'left_right' else 'right_left' end as dir
  from actions_v where action_type = 'foul' and not (match_id = 'm2' and period = 'second_half')
    and not (match_id = 'm3' and period = 'first_half')),
h as (select match_id, max_by(dir, event_id) filter (period = 'first_half') as f,
  max_by(dir, event_id) filter (period = 'second_half') as s from k group by 1),
g as (select match_id, coalesce(f, case s when 'left_right' then 'right_left' when 'right_left' then 'left_right' end) as f,
  coalesce(s, case f when 'left_right' then 'right_left' when 'right_left' then 'left_right' end) as s from h)
select match_id, 'first_half' as period, f as play_direction from g
union all select match_id, 'second_half', s from g
""",
)
def play_direction(t: Tables) -> DataFrame:
    kickoffs = t.actions().filter(
        "action_type = 'foul' and not (match_id = 'm2' and period = 'second_half')"
        " and not (match_id = 'm3' and period = 'first_half')"
    )
    kickoffs = kickoffs.select(
        "match_id", "period", "seq",
        F.when(F.col("event_id") % 13 < 7, "home").otherwise("away").alias("team_left"),
        F.lit("home").alias("home_team_id"),
    )
    return E.play_direction(kickoffs)


_ROLE_CASES = " ".join(f"when {_lit(k)} then {_lit(v)}" for k, v in K.ROLE_BY_LABEL.items())
_LABELS = (*K.ROLE_BY_LABEL, "XX")


@query(
    "role_bucket",
    "tracking_v",
    f"""
with lab as (select event_id, ([{", ".join(map(_lit, _LABELS))}])[1 + event_id % {len(_LABELS)}] as label from tracking_v)
select event_id, case label {_ROLE_CASES} end as role from lab
""",
)
def role_bucket(t: Tables) -> DataFrame:
    label = F.element_at(
        F.array(*[F.lit(v) for v in _LABELS]), (F.col("event_id") % len(_LABELS) + 1).cast("int")
    )
    return t.tracking().select("event_id", S.role_of(label).alias("role"))


_XML_CODES = list(K.POSITIONS_XML) + ["??"]
_LABEL_CASES = " ".join(
    f"when {_lit(k)} then {_lit(v[0]) if v[0] else 'null'}" for k, v in K.POSITIONS_XML.items()
)
_GROUP_CASES = " ".join(f"when {_lit(k)} then {_lit(v[1])}" for k, v in K.POSITIONS_XML.items())


@query(
    "position_codes",
    "tracking_v",
    f"""
with raw as (select event_id, ([{", ".join(map(_lit, _XML_CODES))}])[1 + event_id % {len(_XML_CODES)}] as code from tracking_v)
select event_id, case code {_LABEL_CASES} end as position_label, case code {_GROUP_CASES} end as position_group from raw
""",
)
def position_codes(t: Tables) -> DataFrame:
    code = F.element_at(
        F.array(*[F.lit(v) for v in _XML_CODES]), (F.col("event_id") % len(_XML_CODES) + 1).cast("int")
    )
    labels = {c: lab for c, (lab, _) in K.POSITIONS_XML.items() if lab}
    groups = {c: g for c, (_, g) in K.POSITIONS_XML.items()}
    return t.tracking().select(
        "event_id",
        S.lookup(code, labels).alias("position_label"),
        S.lookup(code, groups).alias("position_group"),
    )


@query(
    "id_clean",
    "stream_v",
    """
with r as (select event_id, case event_id % 3 when 0 then concat(cast(user_id as varchar), '.0')
  when 1 then concat('u', cast(user_id as varchar)) else cast(user_id as varchar) end as raw from stream_v)
select event_id, coalesce(cast(try_cast(try_cast(raw as double) as bigint) as varchar), raw) as id from r
""",
)
def id_clean(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.concat(user, F.lit(".0"))).when(kind == 1, F.concat(F.lit("u"), user)).otherwise(user)
    return t.view("stream_v").select("event_id", S.clean_id(raw).alias("id"))


@query(
    "outlier_cap",
    "tracking_v",
    """
select event_id, case when abs(speed_kmh) <= 40 then speed_kmh end as speed_kmh,
  case when abs(speed_kmh) <= 40 and abs(acceleration_ms2) <= 4 then acceleration_ms2 end as acceleration_ms2
from tracking_v
""",
)
def outlier_cap(t: Tables) -> DataFrame:
    speed = S.cap(F.col("speed_kmh"), 40.0)
    accel = F.when(speed.isNotNull(), S.cap(F.col("acceleration_ms2"), 4.0))
    return t.tracking().select("event_id", speed.alias("speed_kmh"), accel.alias("acceleration_ms2"))


@query(
    "vis_null",
    "tracking_v",
    """
select event_id, case when source = 'B' and not is_visible then null else speed_kmh end as speed_kmh,
  case when source = 'B' and not is_visible then null else distance_m end as distance_m from tracking_v
""",
)
def vis_null(t: Tables) -> DataFrame:
    source, visible = F.col("source"), F.col("is_visible")
    return t.tracking().select(
        "event_id",
        S.hidden_to_null(F.col("speed_kmh"), source, visible, "B").alias("speed_kmh"),
        S.hidden_to_null(F.col("distance_m"), source, visible, "B").alias("distance_m"),
    )


@query(
    "round3",
    "tracking_v",
    "select event_id, round(x / 7 + 1e-9, 3) as x, round(y / 7 + 1e-9, 3) as y from tracking_v",
)
def round3(t: Tables) -> DataFrame:
    return t.tracking().select(
        "event_id", F.round(F.col("x") / 7 + 1e-9, 3).alias("x"), F.round(F.col("y") / 7 + 1e-9, 3).alias("y")
    )


_ACTIONS = [*K.EVENT_TYPE_BY_ACTION, "tackle"]
_RESULTS = ["success", "fail", "offside", "saved", "own_goal", "other"]
_TYPE_CASES = " ".join(f"when {_lit(a)} then {_lit(v[0])}" for a, v in K.EVENT_TYPE_BY_ACTION.items())
_SUB_CASES = " ".join(
    f"when {_lit(a)} then {_lit(v[1]) if v[1] else 'null'}" for a, v in K.EVENT_TYPE_BY_ACTION.items()
)


@query(
    "action_map",
    "actions_v",
    f"""
with a as (select event_id, ([{", ".join(map(_lit, _ACTIONS))}])[1 + event_id % {len(_ACTIONS)}] as act,
  ([{", ".join(map(_lit, _RESULTS))}])[1 + event_id % {len(_RESULTS)}] as res from actions_v)
select event_id, case act {_TYPE_CASES} else 'misc' end as type, case act {_SUB_CASES} else 'other_ball_action' end as sub_type,
  case when res = 'success' then true when res <> 'other' then false end as is_successful,
  case when act like 'shot%' then case when res in ('saved', 'own_goal') then res when res = 'success' then 'successful' end
    when act in ({", ".join(map(_lit, K.PASS_LIKE))}) then
      case when res = 'success' then 'successful' when res in ('offside', 'fail') then 'out_of_play' end
    when act = 'clearance' then 'successful' when act in ('bad_touch', 'non_action') then 'unsuccessful' end as outcome_type,
  act in ('pass', 'shot', 'shot_freekick', 'throw_in') as is_comparable
from a
""",
)
def action_map(t: Tables) -> DataFrame:
    def pick(values: list[str]) -> F.Column:
        index = (F.col("event_id") % len(values) + 1).cast("int")
        return F.element_at(F.array(*[F.lit(v) for v in values]), index)

    df = t.actions().select("event_id", pick(_ACTIONS).alias("act"), pick(_RESULTS).alias("res"))
    act, res = F.col("act"), F.col("res")
    return df.select(
        "event_id",
        S.event_type(act).alias("type"),
        S.event_sub_type(act).alias("sub_type"),
        S.success_flag(res).alias("is_successful"),
        S.outcome_type(act, res).alias("outcome_type"),
        S.comparable(act).alias("is_comparable"),
    )


# Actions -------------------------------------------------------------------------------


def raw_events(t: Tables) -> DataFrame:
    """Nested raw events in the shape of the XML feed, derived from the event stream."""
    e = F.col("event_id")
    who = F.col("player_id")
    none = F.lit(None).cast("string")

    def flag(condition) -> F.Column:
        return F.when(condition, F.lit("1"))

    def play(cross) -> F.Column:
        return F.struct(
            who.alias("_Player"), F.col("team_id").alias("_Team"),
            F.concat(F.lit("r"), who).alias("_Recipient"),
            F.when(F.col("result") == "success", "successfullyCompleted").otherwise("unsuccessful").alias("_Evaluation"),
            flag(cross).alias("Cross"),
        )

    def shot() -> F.Column:
        return F.struct(
            who.alias("_Player"), F.col("team_id").alias("_Team"),
            F.when(e % 5 == 0, "penalty").when(e % 5 == 1, "freeKick").alias("_TakerSetup"),
            F.when(e % 2 == 0, "freeKick").otherwise("run").alias("_BuildUp"),
            *[flag(e % 7 == i).alias(tag) for i, tag in enumerate(K.SHOT_OUTCOMES)],
        )

    kind = (
        F.when(F.col("action_type") == "pass", F.element_at(F.array(*map(F.lit, ("Play", "Play", "FreeKick", "CornerKick"))), (e % 4 + 1).cast("int")))
        .when(F.col("action_type") == "throw_in", F.when(e % 5 == 0, "GoalKick").otherwise("ThrowIn"))
        .when(F.col("action_type") == "shot", F.element_at(F.array(*map(F.lit, ("ShotAtGoal", "Penalty", "FreeKickShot"))), (e % 3 + 1).cast("int")))
        .when(F.col("action_type") == "offside", F.when(e % 6 == 0, "KickOff").otherwise("Offside"))
        .otherwise(F.when(e % 2 == 0, "Foul").otherwise("OtherBallAction"))
    )
    df = t.actions().withColumn("kind", kind)
    k = F.col("kind")
    cross = e % 8 < 3
    return df.select(
        "match_id", "event_id", "seq", "period", "source", "start_x", "start_y", "end_x", "end_y", "t_ms",
        F.when(k == "Play", play(cross)).alias("Play"),
        F.when(k == "ShotAtGoal", shot()).alias("ShotAtGoal"),
        F.when(
            k.isin("FreeKick", "FreeKickShot"),
            F.struct(F.when(k == "FreeKick", play(cross)).alias("Play"), F.when(k == "FreeKickShot", shot()).alias("ShotAtGoal")),
        ).alias("FreeKick"),
        F.when(k == "CornerKick", F.struct(play(cross).alias("Play"))).alias("CornerKick"),
        F.when(k == "Penalty", F.struct(shot().alias("ShotAtGoal"))).alias("Penalty"),
        F.when(k == "KickOff", F.struct(F.col("team_id").alias("_TeamLeft"), F.col("period").alias("_GameSection"))).alias("KickOff"),
        F.when(k == "Foul", F.struct(who.alias("_Fouled"), F.col("team_id").alias("_TeamFouled"))).alias("Foul"),
        F.when(
            k == "OtherBallAction",
            F.struct(who.alias("_Player"), F.col("team_id").alias("_Team"), F.when(e % 3 == 0, "true").alias("_DefensiveClearance")),
        ).alias("OtherBallAction"),
        F.when(k == "GoalKick", F.struct(F.col("team_id").alias("_Team"), play(cross).alias("Play"))).alias("GoalKick"),
        F.when(
            k == "ThrowIn",
            F.struct(F.col("team_id").alias("_Team"), F.when(e % 9 != 0, play(cross)).alias("Play")),
        ).alias("ThrowIn"),
        F.when(k == "Offside", F.struct(none.alias("_x"))).alias("Offside"),
    )


_CLASS_SQL = """
kinds as (select *, case action_type
    when 'pass' then (['Play', 'Play', 'FreeKick', 'CornerKick'])[1 + event_id % 4]
    when 'throw_in' then case when event_id % 5 = 0 then 'GoalKick' else 'ThrowIn' end
    when 'shot' then (['ShotAtGoal', 'Penalty', 'FreeKickShot'])[1 + event_id % 3]
    when 'offside' then case when event_id % 6 = 0 then 'KickOff' else 'Offside' end
    else case when event_id % 2 = 0 then 'Foul' else 'OtherBallAction' end end as kind from actions_v),
classed as (select match_id, event_id, seq, period, source, start_x, start_y, end_x, end_y, t_ms,
  case kind when 'Play' then case when event_id % 8 < 3 then 'cross' else 'pass' end
    when 'FreeKick' then case when event_id % 8 < 3 then 'freekick_cross' else 'freekick_short' end
    when 'CornerKick' then case when event_id % 8 < 3 then 'corner_cross' else 'corner_short' end
    when 'ShotAtGoal' then case when event_id % 5 = 0 then 'shot_penalty'
       when event_id % 5 = 1 and event_id % 2 = 0 then 'shot_freekick' else 'shot' end
    when 'Penalty' then 'shot_penalty' when 'FreeKickShot' then 'shot_freekick' when 'Foul' then 'foul'
    when 'OtherBallAction' then case when event_id % 3 = 0 then 'clearance' end
    when 'GoalKick' then 'goalkick' when 'ThrowIn' then 'throw_in' when 'Offside' then 'offside' end as action_type,
  case when kind = 'Offside' then '' when kind = 'ThrowIn' and event_id % 9 = 0 then '' else player_id end as player_id,
  case when kind = 'Offside' then '' else team_id end as raw_team_id,
  case when kind in ('Play', 'FreeKick', 'CornerKick') then result
    when kind in ('ShotAtGoal', 'Penalty', 'FreeKickShot') then case event_id % 7 when 0 then 'success' when 1 then 'own_goal'
      when 2 then 'saved' when 3 then 'blocked' when 4 then 'wide' when 5 then 'woodwork' else 'fail' end
    when kind = 'Foul' then 'fail' when kind = 'Offside' then 'marker' else 'success' end as result,
  case when kind in ('Play', 'FreeKick', 'CornerKick') and result = 'success' then concat('r', player_id) end as receiver_id
  from kinds where kind <> 'KickOff' and not (kind = 'OtherBallAction' and event_id % 3 <> 0))
"""


@query(
    "action_class",
    "actions_v",
    f"with {_CLASS_SQL.strip()} select event_id, action_type, player_id, raw_team_id, result, receiver_id from classed",
)
def action_class(t: Tables) -> DataFrame:
    return E.classify_events(raw_events(t)).select(
        "event_id", "action_type", "player_id", "raw_team_id", "result", "receiver_id"
    )


def _balance_sql(order: str, source: str, ahead: int = 7) -> str:
    terms = []
    for k in range(1, ahead + 1):
        frame = f"(partition by match_id order by {order} rows between 1 following and {k} following)"
        terms.append(f"coalesce(sum(st) over {frame} = -1 and sum(em) over {frame} < 4, false)")
    return f"""
steps as (select *, case when action_type = 'offside' then -1
    when action_type in ('pass', 'cross', 'freekick_short', 'freekick_cross', 'throw_in') and result = 'fail' then 1 else 0 end as st,
    case when action_type = 'offside' then 0 else 1 end as em from {source}),
balanced as (select *, st = 1 and ({" or ".join(terms)}) as taken from steps),
patched as (select * exclude (result, st, em, taken), case when taken then 'offside' else result end as result
  from balanced where em = 1)
"""


@query(
    "offside_patch",
    "actions_v",
    f"with {_balance_sql('seq', 'actions_v').strip()} select match_id, event_id, action_type, result from patched",
)
def offside_patch(t: Tables) -> DataFrame:
    out = E.mark_offside(t.actions(), ["match_id"], "seq")
    return out.select("match_id", "event_id", "action_type", "result")


_REKEY_SQL = """
nxt as (select *, lead(player_id) over w as np, lead(team_id) over w as nt, lead(start_x) over w as nx, lead(start_y) over w as ny
  from {src} window w as (partition by match_id order by seq)),
rekeyed as (select * exclude (player_id, start_x, start_y, np, nt, nx, ny),
  case when action_type = 'throw_in' and np <> '' and nt = team_id then np else player_id end as player_id,
  case when action_type = 'throw_in' and np <> '' and nt = team_id and nx is not null then nx else start_x end as start_x,
  case when action_type = 'throw_in' and np <> '' and nt = team_id and nx is not null then ny else start_y end as start_y
  from nxt)
"""


@query(
    "rekey_next",
    "actions_v",
    f"with {_REKEY_SQL.format(src='actions_v').strip()} select event_id, player_id, start_x, start_y from rekeyed",
)
def rekey_next(t: Tables) -> DataFrame:
    return E.rekey_throw_ins(t.actions(), ["match_id"], "seq").select(
        "event_id", "player_id", "start_x", "start_y"
    )


_POSSESSIONS = """
select match_id, source, event_id, period, team_id, player_id, start_x, start_y, end_x, end_y,
  case event_id % 7 when 0 then 'throw_in_reception' else 'unknown' end as start_type,
  case event_id % 6 when 0 then 'pass' when 1 then 'shot' when 2 then 'clearance' when 3 then 'foul_suffered'
    when 4 then 'possession_loss' else null end as end_type,
  case event_id % 4 when 0 then 'successful' when 2 then 'offside' else 'unsuccessful' end as pass_outcome,
  case event_id % 5 when 1 then 'free_kick_for' else 'none' end as game_interruption_before,
  case event_id % 3 when 1 then 'True' else 'False' end as lead_to_goal,
  concat(cast(event_id % 50 as {s}), '.0') as player_targeted_id,
  cast(t_ms as {s}) as time_end_utc
from actions_v
"""
_POSSESSION_SQL = f"""
p as ({_POSSESSIONS.format(s='varchar').strip()}),
main as (select match_id, source, period, team_id, player_id, start_x, start_y, end_x, end_y, cast(event_id as varchar) as event_id,
  case end_type when 'pass' then 'pass' when 'shot' then case when game_interruption_before = 'free_kick_for' then 'shot_freekick' else 'shot' end
    when 'clearance' then 'clearance' when 'foul_suffered' then 'foul' when 'possession_loss' then 'bad_touch' else 'non_action' end as action_type,
  case end_type when 'pass' then case pass_outcome when 'successful' then 'success' when 'offside' then 'offside' else 'fail' end
    when 'shot' then case when lead_to_goal = 'True' then 'success' else 'fail' end when 'clearance' then 'success' else 'fail' end as result,
  case when end_type = 'pass' and pass_outcome = 'successful' then cast(cast(cast(player_targeted_id as double) as bigint) as varchar) end as receiver_id,
  case when end_type = 'pass' and pass_outcome = 'successful' then time_end_utc end as receiver_time from p),
possessions as (select * from main union all
  select match_id, source, period, team_id, player_id, start_x, start_y, end_x, end_y, concat(cast(event_id as varchar), '_ti'), 'throw_in', 'success', null, null
  from p where start_type = 'throw_in_reception')
"""


def possessions(t: Tables) -> DataFrame:
    return E.possession_actions(t.sql("actions_v", _POSSESSIONS.format(s="string")))


@query(
    "possession_actions",
    "actions_v",
    f"with {_POSSESSION_SQL.strip()} select match_id, event_id, action_type, result, receiver_id, receiver_time from possessions",
)
def possession_actions(t: Tables) -> DataFrame:
    return possessions(t).select("match_id", "event_id", "action_type", "result", "receiver_id", "receiver_time")


@query(
    "event_period",
    "actions_v",
    """
with k as (select match_id, min(t_ms) filter (action_type = 'shot' and event_id % 10 = 0) + 1000 as kick from actions_v
  where match_id <> 'm1' group by 1)
select event_id, case when t_ms >= kick then 'second_half' else 'first_half' end as period
from actions_v a left join k on a.match_id = k.match_id
""",
)
def event_period(t: Tables) -> DataFrame:
    actions = t.actions().drop("period")
    kick = (
        actions.filter("match_id <> 'm1'")
        .groupBy("match_id")
        .agg((F.min(F.when((F.col("action_type") == "shot") & (F.col("event_id") % 10 == 0), F.col("t_ms"))) + 1000).alias("kick"))
    )
    out = actions.join(kick, "match_id", "left")
    return out.select("event_id", E.period_by_kickoff(F.col("t_ms"), F.col("kick")).alias("period"))


def _repaired(t: Tables) -> DataFrame:
    classed = materialise(E.classify_events(raw_events(t)).withColumnRenamed("raw_team_id", "team_id"))
    patched = E.mark_offside(classed, ["match_id"], "seq")
    return E.rekey_throw_ins(patched, ["match_id"], "seq")


def unified(t: Tables) -> DataFrame:
    first = _repaired(t).withColumns(
        {"source": F.lit("A"), "competition": F.lit("one"), "timestamp": F.col("t_ms").cast("string")}
    )
    second = possessions(t).withColumns({"source": F.lit("B"), "competition": F.lit("two")})
    return E.conform_actions(first, second)


_UNION_SQL = f"""
{_CLASS_SQL.strip()},
renamed as (select * exclude (raw_team_id), raw_team_id as team_id from classed),
{_balance_sql("seq", "renamed").strip()},
{_REKEY_SQL.format(src="patched").strip()},
{_POSSESSION_SQL.strip()},
unified as (
  select cast(event_id as varchar) as event_id, match_id, cast(t_ms as varchar) as timestamp, period, action_type, player_id, team_id,
    receiver_id, null as receiver_time, result, start_x, start_y, end_x, end_y, 'A' as source, 'one' as competition from rekeyed
  union all
  select event_id, match_id, null, period, action_type, player_id, team_id, receiver_id, receiver_time, result,
    start_x, start_y, end_x, end_y, 'B', 'two' from possessions)
"""


@query(
    "actions_union",
    "actions_v",
    f"""
with {_UNION_SQL.strip()}
select event_id, match_id, timestamp, period, action_type, player_id, cast(null as varchar) as player_name, team_id,
  cast(null as varchar) as team_name, receiver_id, receiver_time, cast(null as varchar) as body_part,
  cast(null as varchar) as related_event_ids, result, round(start_x, 3) as start_x, start_y, end_x, end_y, source, competition,
  action_type in ('pass', 'shot', 'shot_freekick', 'throw_in') as cross_dataset_comparable
from unified
""",
)
def actions_union(t: Tables) -> DataFrame:
    return unified(t)


@query(
    "action_counts",
    "actions_v",
    f"""
with {_UNION_SQL.strip()}
select dimension, value, count(*) as n from (
  select 'source' as dimension, source as value from unified union all select 'action_type', action_type from unified
  union all select 'result', result from unified union all select 'competition', competition from unified) q group by 1, 2
""",
)
def action_counts(t: Tables) -> DataFrame:
    return E.action_counts(unified(t))


@query(
    "action_pivot",
    "actions_v",
    f"""
with {_UNION_SQL.strip()}
select source, count(*) filter (action_type = 'pass') as "pass", count(*) filter (action_type = 'shot') as shot,
  count(*) filter (action_type = 'shot_freekick') as shot_freekick, count(*) filter (action_type = 'throw_in') as throw_in
from unified where action_type in ('pass', 'shot', 'shot_freekick', 'throw_in') group by source
""",
)
def action_pivot(t: Tables) -> DataFrame:
    return E.comparable_pivot(unified(t))


_STATS_SQL = """
stats as (select match_id, player_id,
  sum(case when action_type = 'foul' and event_id % 3 = 0 then 1 else 0 end) as yellow_cards,
  sum(case when action_type = 'foul' and event_id % 3 = 1 then 1 else 0 end) as red_cards,
  sum(case when action_type = 'shot' and result = 'success' and not (event_id % 10 = 0 and team_id = 'home') then 1 else 0 end) as goals,
  sum(case when action_type = 'shot' and result = 'success' and event_id % 10 = 0 and team_id = 'home' then 1 else 0 end) as own_goals
  from actions_v where (action_type = 'foul' and event_id % 3 < 2) or (action_type = 'shot' and result = 'success') group by 1, 2)
"""


def stats(t: Tables) -> DataFrame:
    actions = t.actions()
    color = F.when(F.col("event_id") % 3 == 0, "yellow").when(F.col("event_id") % 3 == 1, "yellowRed")
    cautions = actions.filter("action_type = 'foul'").select("match_id", "player_id", color.alias("color"))
    shots = actions.filter("action_type = 'shot'").select(
        "match_id", "player_id",
        F.when(F.col("event_id") % 10 == 0, "away").otherwise(F.col("team_id")).alias("team_id"),
        (F.col("result") == "success").alias("is_goal"),
    )
    teams = actions.select("match_id", "player_id", F.col("team_id").alias("roster_team")).distinct()
    return E.player_stats(cautions, shots, teams)


@query(
    "player_stats",
    "actions_v",
    f"with {_STATS_SQL.strip()} select match_id, player_id, cast(yellow_cards as bigint) as yellow_cards, cast(red_cards as bigint) as red_cards, cast(goals as bigint) as goals, cast(own_goals as bigint) as own_goals from stats",
)
def player_stats(t: Tables) -> DataFrame:
    return stats(t)


@query(
    "count_expand",
    "actions_v",
    f"""
with {_STATS_SQL.strip()},
sheet as (
  select match_id, player_id, 'goal' as kind, case when cast(player_id as int) % 2 = 0 then 'home' else 'away' end as team_id, goals as n from stats
  union all select match_id, player_id, 'own_goal', case when cast(player_id as int) % 2 = 0 then 'away' else 'home' end, own_goals from stats
  union all select match_id, player_id, 'yellow_card', case when cast(player_id as int) % 2 = 0 then 'home' else 'away' end, yellow_cards from stats
  union all select match_id, player_id, 'red_card', case when cast(player_id as int) % 2 = 0 then 'home' else 'away' end, red_cards from stats)
select match_id, player_id, kind, team_id, cast(unnest(range(1, cast(n as bigint) + 1)) as int) as copy_no from sheet
""",
)
def count_expand(t: Tables) -> DataFrame:
    home = F.col("player_id").cast("int") % 2 == 0
    rosters = stats(t).withColumns(
        {
            "team_id": F.when(home, "home").otherwise("away"),
            "opponent_id": F.when(home, "away").otherwise("home"),
        }
    )
    return E.expand_counts(rosters)


_BENCH = """
select match_id, team_id, player_id, min(event_id) as seq, min(event_id) % 2 = 0 as starting,
  case when min(event_id) % 2 = 0 then '00:00:00' when min(event_id) % 5 <> 1 then
    concat('01:', lpad(cast(min(event_id) % 7 + 10 as {s}), 2, '0'), ':00') end as start_time,
  case when min(event_id) % 3 <> 0 then concat('01:', lpad(cast(min(event_id) % 7 + 10 as {s}), 2, '0'), ':00') end as end_time
from actions_v group by match_id, team_id, player_id
"""


@query(
    "sub_pairs",
    "actions_v",
    f"""
with r as ({_BENCH.format(s='varchar').strip()}),
o as (select *, row_number() over (partition by match_id, team_id, start_time order by seq) as k from r
  where start_time is not null and start_time <> '00:00:00'),
f as (select *, row_number() over (partition by match_id, team_id, end_time order by seq) as k from r where starting and end_time is not null),
same as (select o.match_id, o.team_id, o.player_id as i, o.start_time as it, f.player_id as u, f.end_time as ut
  from o join f on o.match_id = f.match_id and o.team_id = f.team_id and o.start_time = f.end_time and o.k = f.k),
lo as (select *, row_number() over (partition by match_id, team_id order by seq) as r from o
  where (match_id, team_id, player_id) not in (select (match_id, team_id, i) from same)),
lf as (select *, row_number() over (partition by match_id, team_id order by end_time, seq) as r from f
  where (match_id, team_id, player_id) not in (select (match_id, team_id, u) from same))
select match_id, team_id, i as in_player_id, it as in_time, u as out_player_id, ut as out_time from same
union all select lo.match_id, lo.team_id, lo.player_id, lo.start_time, lf.player_id, lf.end_time
from lo left join lf on lo.match_id = lf.match_id and lo.team_id = lf.team_id and lo.r = lf.r
""",
)
def sub_pairs(t: Tables) -> DataFrame:
    return E.pair_substitutions(t.sql("actions_v", _BENCH.format(s="string")))


@query(
    "period_bounds",
    "harm_v",
    """
select match_id, period, min(frame_id) as frame_id_start, max(frame_id) as frame_id_end,
  min_by(t_ms, frame_id) as time_start, max_by(t_ms, frame_id) as time_end from harm_v group by 1, 2
""",
)
def period_bounds(t: Tables) -> DataFrame:
    return E.period_bounds(t.view("harm_v"), time="t_ms")


@query(
    "whistles",
    "harm_v",
    """
with b as (select match_id, period, min_by(t_ms, frame_id) as s, max_by(t_ms, frame_id) as e from harm_v group by 1, 2)
select match_id, period as type, 'start' as sub_type, s as time from b union all select match_id, period, 'end', e from b
""",
)
def whistles(t: Tables) -> DataFrame:
    return E.whistles(E.period_bounds(t.view("harm_v"), time="t_ms"))
