"""Explicit schemas of the raw feeds."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


FRAME_SET = struct(
    _TeamId=_S,
    _PersonId=_S,
    _GameSection=_S,
    Frame=T.ArrayType(
        struct(_N=_L, _T=_S, _X=_D, _Y=_D, _Z=_D, _S=_D, _A=_D, _M=_I, _BallStatus=_I, _BallPossession=_I)
    ),
)
GENERAL = struct(
    _MatchId=_S, _HomeTeamId=_S, _GuestTeamId=_S, _KickoffTime=_S, _CompetitionId=_S, _CompetitionName=_S,
    _Season=_S, _SeasonId=_S, _MatchDay=_S, _Result=_S, _ResultFirstHalf=_S, _ResultSecondHalf=_S,
)
ENVIRONMENT = struct(_PitchX=_D, _PitchY=_D, _StadiumId=_S, _StadiumName=_S, _StadiumCapacity=_S)
REFEREE = struct(_PersonId=_S, _RefereeId=_S, _FirstName=_S, _LastName=_S, _Shortname=_S, _Role=_S)
_PLAYER = T.ArrayType(
    struct(
        _PersonId=_S, _PlayerId=_S, _FirstName=_S, _LastName=_S, _Shortname=_S, _PlayingPosition=_S,
        _ShirtNumber=_S, _Starting=_S,
    )
)
TEAM = struct(
    _TeamId=_S, _id=_S, _TeamName=_S, _ShortName=_S, _LongName=_S, _Name=_S, Player=_PLAYER, Players=struct(Player=_PLAYER)
)

_MARK = struct(_VALUE=_S, _Side=_S)
_PLAY = struct(_Player=_S, _Team=_S, _Recipient=_S, _Evaluation=_S, Cross=_MARK)
_SHOT = struct(
    _Player=_S, _Team=_S, _TakerSetup=_S, _BuildUp=_S, SuccessfulShot=_MARK, OwnGoal=_MARK, SavedShot=_MARK,
    BlockedShot=_MARK, ShotWide=_MARK, ShotWoodWork=_MARK,
)
_WRAP = struct(_Team=_S, Play=_PLAY, ShotAtGoal=_SHOT)
EVENT = T.StructType(
    [
        T.StructField(name, kind, True)
        for name, kind in {
            "_EventId": _S, "_EventTime": _S, "_X-Position": _D, "_Y-Position": _D,
            "_X-Source-Position": _D, "_Y-Source-Position": _D,
            "Play": _PLAY, "ShotAtGoal": _SHOT, "FreeKick": _WRAP, "CornerKick": _WRAP, "Penalty": _WRAP,
            "GoalKick": _WRAP, "ThrowIn": _WRAP,
            "KickOff": struct(_GameSection=_S, _TeamLeft=_S),
            "Foul": struct(_Fouled=_S, _TeamFouled=_S),
            "OtherBallAction": struct(_Player=_S, _Team=_S, _DefensiveClearance=_S),
            "Offside": struct(_Player=_S, _Team=_S),
            "Substitution": struct(_PlayerIn=_S, _PlayerOut=_S, _PlayingPosition=_S),
            "Caution": struct(_Player=_S, _CardColor=_S),
        }.items()
    ]
)

FRAME_JSON = struct(
    frame=_L, period=_I, timestamp=_S,
    ball_data=struct(x=_D, y=_D, z=_D),
    possession=struct(player_id=_L, group=_S),
    player_data=T.ArrayType(struct(player_id=_L, x=_D, y=_D, is_detected=_B)),
    _corrupt_record=_S,
)
_NAMED = struct(id=_L, name=_S)
MATCH_JSON = struct(
    home_team=struct(id=_L, short_name=_S), away_team=struct(id=_L, short_name=_S),
    pitch_length=_D, pitch_width=_D, home_team_score=_I, away_team_score=_I, date_time=_S,
    competition=struct(name=_S),
    competition_edition=struct(competition=_NAMED, season=_NAMED),
    competition_round=struct(round_number=_I),
    stadium=struct(id=_L, name=_S, capacity=_I),
    referees=T.ArrayType(struct(id=_L, first_name=_S, last_name=_S, short_name=_S, type=_S, role=_S)),
    match_periods=T.ArrayType(struct(period=_I, duration_minutes=_D)),
    home_team_side=T.ArrayType(_S),
    players=T.ArrayType(
        struct(
            id=_L, team_id=_L, short_name=_S, first_name=_S, last_name=_S, number=_I, start_time=_S, end_time=_S,
            yellow_card=_I, red_card=_I, goal=_I, own_goal=_I, player_role=struct(acronym=_S),
        )
    ),
)
MATCH_INDEX = struct(id=_L, date_time=_S)
PHASES_CSV = struct(frame_start=_D, frame_end=_D)
EVENTS_CSV_COLUMNS = (
    "event_id", "event_type", "period", "time_start", "time_end", "x_start", "y_start", "x_end", "y_end",
    "start_type", "end_type", "pass_outcome", "lead_to_goal", "game_interruption_before", "player_id",
    "player_name", "player_targeted_id", "team_id", "team_shortname",
)
