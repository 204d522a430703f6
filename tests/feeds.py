"""Tiny raw feeds with the edge cases the readers must survive."""

from __future__ import annotations

import json
from pathlib import Path

N_RAW = 60  # 25 Hz frames of the first half; every player walks 0.04 m per frame


def _frame(n: int, x: float, y: float, extra: str = "") -> str:
    stamp = f"2025-01-01T12:00:{n * 0.04:06.3f}+00:00"
    return f'<Frame N="{10000 + n}" T="{stamp}" X="{x:.3f}" Y="{y:.3f}" M="1" {extra}/>'


def xml_feed(root: Path) -> Path:
    root.mkdir(parents=True, exist_ok=True)
    (root / "F_02_01_matchinformation_A-1_X1.xml").write_text(
        """<PutDataRequest><MatchInformation>
<General MatchId="M-X1" HomeTeamId="T1" GuestTeamId="T2" KickoffTime="2025-01-01T12:00:00.000Z" CompetitionId="DFL-COM-000001"
 CompetitionName="League One" Season="2024/25" SeasonId="S1" MatchDay="7" Result="2:1" ResultFirstHalf="1:0" ResultSecondHalf="oops"/>
<Environment PitchX="105.0" PitchY="68.0" StadiumId="ST" StadiumName="Park" StadiumCapacity="many"/>
<Teams>
<Team TeamId="T1" TeamName="Home FC"><Players>
 <Player PersonId="P1" FirstName="Ann" LastName="Bee" Shortname="A. Bee" PlayingPosition="TW" ShirtNumber="1" Starting="true"/>
 <Player PersonId="P2" FirstName="Cy" LastName="Dee" Shortname="C. Dee" PlayingPosition="STZ" ShirtNumber="9" Starting="true"/>
 <Player PersonId="P3" FirstName="Eve" LastName="Fox" Shortname="E. Fox" ShirtNumber="1x" Starting="false"/>
 <Player PersonId="P4" FirstName="Sub" LastName="Idle" Shortname="S. Idle" ShirtNumber="12" Starting="false"/>
</Players></Team>
<Team TeamId="T2" TeamName="Away SC"><Players>
 <Player PersonId="Q1" FirstName="Gus" LastName="Hay" Shortname="G. Hay" PlayingPosition="IVZ" ShirtNumber="4" Starting="true"/>
</Players></Team>
</Teams>
<Referees><Referee PersonId="R1" FirstName="Ref" LastName="One" Shortname="R. One" Role="referee"/></Referees>
</MatchInformation></PutDataRequest>"""
    )
    pos = ['<PutDataRequest><Positions>']
    for team, person in (("T1", "P1"), ("T1", "P2"), ("T2", "Q1")):
        pos.append(f'<FrameSet GameSection="firstHalf" MatchId="M-X1" TeamId="{team}" PersonId="{person}">')
        for n in range(N_RAW):
            if person == "P2" and n == 10:
                continue  # one missing frame
            speed = "55.0" if person == "Q1" and n == 20 else "3.6"
            pos.append(_frame(n, 0.04 * n + (5 if team == "T2" else 0), 1.0, f'S="{speed}" A="0.5" D="0.04"'))
        pos.append("</FrameSet>")
    pos.append('<FrameSet GameSection="firstHalf" MatchId="M-X1" TeamId="BALL" PersonId="B">')
    pos += [
        _frame(n, 0.1 * n, 0.0, f'Z="0.2" BallStatus="{int(n < 30)}" BallPossession="{1 if n < 30 else 2}"')
        for n in range(N_RAW)
    ]
    pos.append("</FrameSet></Positions></PutDataRequest>")
    (root / "F_04_03_positions_raw_observed_A-1_X1.xml").write_text("\n".join(pos))

    def ev(i: int, body: str, x: float = 60.0, y: float = 34.0, src: str = "") -> str:
        return (
            f'<Event EventId="E{i}" EventTime="2025-01-01T12:00:{i:02d}.000+00:00" X-Position="{x}" Y-Position="{y}" {src}>{body}</Event>'
        )

    play = '<Play Player="{p}" Team="{t}" Recipient="P2" Evaluation="{e}">{c}</Play>'
    good, bad = "successfullyCompleted", "unsuccessful"
    events = [
        ev(0, '<KickOff GameSection="firstHalf" TeamLeft="T2"/>'),
        ev(1, play.format(p="P1", t="T1", e=good, c=""), src='X-Source-Position="50.0" Y-Source-Position="30.0"'),
        ev(2, play.format(p="P1", t="T1", e=bad, c="<Cross/>")),
        ev(3, play.format(p="P2", t="T1", e=bad, c="")),
        ev(4, "<Offside/>"),
        ev(5, "<Offside/>"),
        ev(6, '<ThrowIn Team="T1">' + play.format(p="P1", t="T1", e=good, c="") + "</ThrowIn>"),
        ev(7, play.format(p="P2", t="T1", e=good, c=""), x=70.0),
        ev(8, '<ThrowIn Team="T1"><FairPlay/></ThrowIn>'),
        ev(9, '<ShotAtGoal Player="Q1" Team="T2" TakerSetup="x" BuildUp="y"><SavedShot Side="left"/></ShotAtGoal>'),
        ev(10, '<Penalty Team="T1"><ShotAtGoal Player="P2" Team="T1"><SuccessfulShot/></ShotAtGoal></Penalty>'),
        ev(11, '<OtherBallAction Player="Q1" Team="T2" DefensiveClearance="true"/>'),
        ev(12, '<OtherBallAction Player="Q1" Team="T2"/>'),
        ev(13, '<Foul Fouled="P1" TeamFouled="T1"/>'),
        ev(14, '<GoalKick Team="T2">' + play.format(p="Q1", t="T2", e=good, c="") + "</GoalKick>"),
        ev(15, '<CornerKick Team="T1">' + play.format(p="P1", t="T1", e=good, c="<Cross/>") + "</CornerKick>"),
        ev(16, '<FreeKick Team="T1"><ShotAtGoal Player="P2" Team="T1"><ShotWide/></ShotAtGoal></FreeKick>'),
        ev(17, '<Caution Player="P2" CardColor="yellow"/>'),
        ev(18, '<ShotAtGoal Player="Q1" Team="T1" TakerSetup="penalty"><SuccessfulShot/></ShotAtGoal>'),
        ev(19, '<Substitution PlayerIn="P3" PlayerOut="P2" PlayingPosition="STL"/>'),
    ]
    (root / "F_03_02_events_raw_A-1_X1.xml").write_text(
        "<PutDataRequest>" + "\n".join(events) + "</PutDataRequest>"
    )
    return root


def json_feed(root: Path) -> Path:
    match = root / "matches" / "501"
    match.mkdir(parents=True, exist_ok=True)
    (root / "matches.json").write_text(json.dumps([{"id": 501, "date_time": "2025-02-01T10:00:00Z"}]))
    sheet = {
        "home_team": {"id": 11, "short_name": "Reds"},
        "away_team": {"id": 22, "short_name": "Blues"},
        "pitch_length": 104, "pitch_width": None, "home_team_score": 1, "away_team_score": 1,
        "date_time": "2025-02-01T10:00:00Z",
        "competition_edition": {"competition": {"id": 61, "name": "League"}, "season": {"id": 9, "name": "2025"}},
        "competition_round": {"round_number": 3}, "stadium": {"id": 5, "name": "Oval", "capacity": 100},
        "referees": [], "match_periods": [{"period": 1, "duration_minutes": 46.0}],
        "home_team_side": ["right_to_left", "left_to_right"],
        "players": [
            {"id": 1, "team_id": 11, "short_name": "One", "number": 1, "start_time": "00:00:00", "player_role": {"acronym": "GK"}, "goal": 1},
            {"id": 2, "team_id": 11, "short_name": "Two", "number": 2, "start_time": "00:00:00", "end_time": "01:10:00", "player_role": {"acronym": "CF"}},
            {"id": 3, "team_id": 22, "short_name": "Three", "number": 3, "start_time": "00:00:00", "player_role": {"acronym": "DM"}, "yellow_card": 1},
            {"id": 4, "team_id": 11, "short_name": "Four", "number": 14, "start_time": "01:10:00", "player_role": {"acronym": "SUB"}},
        ],
    }
    (match / "501_match.json").write_text(json.dumps(sheet, indent=1))
    lines = []
    for n in range(40):
        players = [
            {"player_id": 1, "x": -40.0 + 0.1 * n, "y": 0.0, "is_detected": True},
            {"player_id": 2, "x": 5.0 + 0.1 * n, "y": 2.0, "is_detected": n != 20},
            {"player_id": 3, "x": None if n == 5 else 8.0 + 0.1 * n, "y": 3.0, "is_detected": True},
        ]
        lines.append(
            json.dumps(
                {
                    "frame": 100 + n, "period": 1, "timestamp": f"00:00:{n / 10:05.2f}",
                    "ball_data": {"x": 1.0, "y": None, "z": 0.1},
                    "possession": {"player_id": 3, "group": None} if n < 10 else {"player_id": None, "group": "home team"},
                    "player_data": players,
                }
            )
        )
    lines.insert(3, '{"frame": 7, "period"')
    lines.append(json.dumps({"frame": None, "period": None, "timestamp": None, "player_data": []}))
    (match / "501_tracking_extrapolated.jsonl").write_text("\n".join(lines) + "\n")
    (match / "501_phases_of_play.csv").write_text("frame_start,frame_end\n100,110\n105,107\n120,130\n")
    head = (
        "event_id,event_type,period,time_start,time_end,x_start,y_start,x_end,y_end,start_type,end_type,pass_outcome,"
        "lead_to_goal,game_interruption_before,player_id,player_name,player_targeted_id,team_id,team_shortname\n"
    )
    rows = [
        "8_0,player_possession,1,00:01.0,00:02.5,10.0,5.0,20.0,6.0,throw_in_reception,pass,successful,,,2,Two,1.0,11.0,Reds",
        "8_1,player_possession,2,45:01.0,45:02.0,10.0,5.0,30.0,,unknown,shot,,True,free_kick_for,3,Three,,22,Blues",
        "8_2,on_ball_engagement,1,00:05.0,00:06.0,1,1,2,2,,,,,,3,Three,,22,Blues",
        "8_3,player_possession,1,00:07.0,00:08.0,1,1,2,2,recovery,possession_loss,,,,3,Three,,22,Blues",
    ]
    (match / "501_dynamic_events.csv").write_text(head + "\n".join(rows) + "\n")
    return root
