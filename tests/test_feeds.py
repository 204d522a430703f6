import json

import pytest
from feeds import json_feed, xml_feed
from pyspark.sql import functions as F

from touchline.plans import harmonise
from touchline.sources import json_feed as JF
from touchline.sources import sinks
from touchline.sources import xml_feed as XF
from touchline.sources.files import Files
from touchline.streaming.ingest import ingest_frames


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    base = tmp_path_factory.mktemp("feeds")
    return str(xml_feed(base / "xml")), str(json_feed(base / "json"))


def test_xml_match_sheet(spark, roots):
    row = XF.matches(spark, roots[0]).first()
    assert (row.match_id, row.competition, row.match_day) == ("X1", "Bundesliga", 7)
    assert (row.home_score, row.away_score, row.first_half_home) == (2, 1, 1)
    assert row.second_half_home is None and row.stadium_capacity is None
    assert row.kickoff_time_utc == "2025-01-01T12:00:00+00:00"
    assert XF.referees(spark, roots[0]).count() == 1


def test_xml_rosters_use_events(spark, roots):
    rows = {r.player_id: r for r in XF.rosters(spark, roots[0]).collect()}
    assert len(rows) == 5
    assert rows["P3"].shirt_number is None
    assert (rows["P3"].position_raw, rows["P3"].position_label, rows["P3"].start_time) == ("STL", "LCF", "00:00:19")
    assert (rows["P4"].position_raw, rows["P4"].position_group, rows["P4"].start_time) == ("SUB", "SUB", None)
    assert (rows["P2"].end_time, rows["P2"].goals, rows["P2"].yellow_cards) == ("00:00:19", 1, 1)
    assert (rows["Q1"].goals, rows["Q1"].own_goals) == (0, 1)


def test_xml_direction_is_inferred(spark, roots):
    got = {r.period: r.play_direction for r in XF.directions(spark, roots[0]).collect()}
    assert got == {"first_half": "right_left", "second_half": "left_right"}


def test_xml_tracking_is_thinned(spark, roots):
    rows = XF.tracking(spark, roots[0]).orderBy("player_id", "frame_id_source").collect()
    p1 = [r for r in rows if r.player_id == "P1"]
    assert [r.frame_id_source - 10000 for r in p1] == [n for n in range(60) if n % 5 in (0, 2)]
    assert p1[0].distance_m is None and p1[1].distance_m == 0.08 and p1[2].distance_m == 0.12
    p2 = {r.frame_id_source - 10000: r for r in rows if r.player_id == "P2"}
    assert 10 not in p2 and p2[12].distance_m is None and p2[15].distance_m == 0.12
    assert p1[0].ball_status is True and p1[0].ball_poss_team_id == "T1"
    assert p1[-1].ball_status is False and p1[-1].ball_poss_team_id == "T2"
    assert {r.is_home for r in rows if r.team_id == "T2"} == {False}


def test_xml_actions(spark, roots):
    rows = XF.actions(spark, roots[0]).collect()
    by_id = {r.event_id: r for r in rows}
    kinds = {k: r.action_type for k, r in by_id.items()}
    assert kinds == {
        "E1": "pass", "E2": "cross", "E3": "pass", "E6": "throw_in", "E7": "pass", "E8": "throw_in", "E9": "shot",
        "E10": "shot_penalty", "E11": "clearance", "E13": "foul", "E14": "goalkick", "E15": "corner_cross",
        "E16": "shot_freekick", "E18": "shot_penalty",
    }
    assert by_id["E3"].result == "offside" and by_id["E2"].result == "offside"
    assert by_id["E9"].result == "saved" and by_id["E10"].result == "success" and by_id["E16"].result == "wide"
    assert by_id["E1"].receiver_id == "P2" and by_id["E3"].receiver_id is None
    # Home attacked right to left in the first half, so x is mirrored.
    assert by_id["E1"].start_x == 2.5 and by_id["E1"].end_x == -7.5 and by_id["E1"].start_y == -4.0
    # The throw-in moves to the next action of the same team; the faulty one is followed by an opponent.
    assert (by_id["E6"].player_id, by_id["E6"].start_x) == ("P2", -17.5)
    assert by_id["E8"].player_id == "" and by_id["E8"].team_id == "T1"
    assert by_id["E13"].player_id == "P1"
    assert {r.period for r in rows} == {"first_half"}


def test_json_frames_and_sheet(spark, roots):
    assert JF.frames(spark, roots[1]).count() == 40
    row = JF.matches(spark, roots[1]).first()
    assert (row.match_id, row.home_team_id, row.pitch_length, row.pitch_width) == ("501", "11", 104.0, 68.0)
    assert JF.referees(spark, roots[1]).count() == 0
    got = {r.period: r.play_direction for r in JF.directions(spark, roots[1]).collect()}
    assert got == {"first_half": "right_left", "second_half": "left_right"}


def test_json_tracking(spark, roots):
    rows = {(r.player_id, r.frame_id_source): r for r in JF.tracking(spark, roots[1]).collect()}
    assert len(rows) == 120
    assert rows["1", 101].speed_kmh == pytest.approx(3.6) and rows["1", 100].speed_kmh is None
    assert rows["2", 120].x is None and rows["2", 121].speed_kmh is None and rows["2", 122].speed_kmh == pytest.approx(3.6)
    # A visible row without coordinates keeps the memory: the next step spans two frames.
    assert rows["3", 105].x is None and rows["3", 106].distance_m == pytest.approx(0.2)
    assert rows["1", 103].timestamp == "2025-02-01T10:00:00.300000+00:00"
    assert [rows["1", f].ball_status for f in (104, 107, 108, 111, 125)] == [True, True, False, False, True]
    assert rows["1", 100].ball_poss_team_id == "22" and rows["1", 115].ball_poss_team_id == "11"
    assert rows["1", 100].match_minute == 1 and rows["1", 100].is_home


def test_json_actions(spark, roots):
    rows = {r.event_id: r for r in JF.actions(spark, roots[1]).collect()}
    assert {k: r.action_type for k, r in rows.items()} == {
        "8_0_ti": "throw_in", "8_0": "pass", "8_1": "shot_freekick", "8_3": "bad_touch",
    }
    assert (rows["8_0"].start_x, rows["8_0"].receiver_id, rows["8_0"].team_id) == (-10.0, "1", "11")
    assert rows["8_0"].timestamp == "2025-02-01T10:00:01+00:00"
    assert rows["8_0"].receiver_time == "2025-02-01T10:00:02.500000+00:00"
    assert (rows["8_1"].start_x, rows["8_1"].end_x, rows["8_1"].result) == (10.0, None, "success")
    # Second half starts after 46 minutes plus the break.
    assert rows["8_1"].timestamp == "2025-02-01T11:46:01+00:00"


def test_run_end_to_end_and_resume(spark, roots, tmp_path):
    out = str(tmp_path / "out")
    feeds = harmonise.Feeds(*roots)
    status = {r.match_id: r for r in harmonise.run(spark, feeds, out).collect()}
    assert {k: r.status for k, r in status.items()} == {"X1": "ok", "501": "ok"}
    assert status["501"].rows == 120 and status["X1"].rows == 24 * 2 + 23

    tracking = harmonise.read(spark, out, "tracking")
    frames = tracking.groupBy("match_id").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b")).collect()
    assert {(str(r.match_id), r.a, r.b) for r in frames} == {("X1", 0, 23), ("501", 0, 39)}
    spike = tracking.filter("player_id = 'Q1' and frame_id_source = 10020").first()
    assert spike.speed_kmh is None and spike.acceleration_ms2_filtered is None
    first = tracking.filter("player_id = 'Q1' and frame_id_source = 10000").first()
    assert first.x == -5.0 and first.speed_kmh_filtered == 3.6
    walk = tracking.filter("player_id = '1'").orderBy("frame_id").collect()
    assert walk[0].speed_kmh_filtered is None and walk[20].speed_kmh_filtered == pytest.approx(3.6, abs=1e-3)
    assert walk[20].acceleration_ms2_filtered == pytest.approx(0.0, abs=1e-3)
    hidden = tracking.filter("player_id = '2' and frame_id_source = 120").first()
    assert hidden.is_visible is False and hidden.speed_kmh_filtered is None

    lines = [json.loads(r.value) for r in harmonise.read(spark, out, "frames").collect()]
    one = next(o for o in lines if o["match"]["id"] == "501" and o["frame_id"] == 20)
    assert [p["id"] for p in one["teams"]["home"]["players"]] == ["1", "2"]
    assert one["teams"]["home"]["players"][1]["x"] is None and "vel" not in one["teams"]["home"]["players"][1]
    assert one["ball"]["y"] is None and one["teams"]["away"]["id"] == "22"
    assert one["teams"]["home"]["players"][0]["vel"] == pytest.approx(1.0, abs=1e-3)

    sheets = {r["match_id"]: r.asDict(True) for r in harmonise.read(spark, out, "sheets").collect()}
    x1 = sheets["X1"]
    assert x1["match"]["result"]["winning_team_id"] == "T1"
    assert x1["match"]["periods"][0]["left_team_id"] == "T2" and len(x1["match"]["whistles"]) == 2
    assert {g["is_own_goal"] for g in x1["match"]["events"]["goals"]} == {True, False}
    assert x1["match"]["events"]["substitutions"][0]["out_player_id"] == "P2"
    assert sheets["501"]["match"]["result"].get("winning_team_id") is None

    events = [json.loads(r.value) for r in harmonise.read(spark, out, "event_lines").collect()]
    shot = next(e for e in events if e["event"]["id"] == "E16")
    assert (shot["event"]["type"], shot["event"]["sub_type"], shot["event"]["outcome_type"]) == ("shot", "free_kick", "wide")
    assert "body_part" in shot["event"] and shot["event"]["body_part"] is None
    assert shot["meta"] == {"is_synced": True}

    again = harmonise.run(spark, feeds, out).collect()
    assert {r.status for r in again} == {"skipped"}
    assert harmonise.read(spark, out, "tracking").count() == 191


def add_match(root, match_id):
    """A copy of match 501 under another id, with the columns of its event file turned round."""
    old, new = root / "matches" / "501", root / "matches" / match_id
    new.mkdir()
    for path in old.iterdir():
        text = path.read_text()
        if path.name.endswith("_dynamic_events.csv"):
            text = "\n".join(",".join(reversed(line.split(","))) for line in text.splitlines()) + "\n"
        (new / path.name.replace("501", match_id)).write_text(text)


def test_csv_columns_go_by_each_header(spark, tmp_path):
    root = json_feed(tmp_path / "json")
    add_match(root, "502")
    names = ("event_id", "player_name", "team_id", "not_there")
    rows = JF.read_csv(spark, str(root), "events", names)
    by_match = {m: sorted(tuple(r)[1:] for r in rows.collect() if r.match_id == m) for m in ("501", "502")}
    assert by_match["501"] == by_match["502"] and ("8_0", "Two", "11.0", None) in by_match["501"]
    one = Files(str(root), {"events": [f"{root}/matches/502/502_dynamic_events.csv"]})
    assert {r.match_id for r in JF.read_csv(spark, one, "events", names).collect()} == {"502"}
    assert JF.read_csv(spark, one, "phases", names).collect() == []
    kinds = {m: sorted(r.action_type for r in JF.actions(spark, str(root)).collect() if r.match_id == m) for m in ("501", "502")}
    assert kinds["501"] == kinds["502"] and len(kinds["501"]) == 4


def written(spark, out):
    """Everything below an output folder, as comparable text."""
    found = {}
    for name in ("tracking", "actions"):
        rows = harmonise.read(spark, out, name)
        found[name] = sorted(str([r[c] for c in sorted(rows.columns)]) for r in rows.collect())
    for name in ("frames", "event_lines"):
        found[name] = sorted(r.value for r in harmonise.read(spark, out, name).collect())
    sheets = harmonise.read(spark, out, "sheets")
    found["sheets"] = sorted(str(r.asDict(True)) for r in sheets.select(sorted(sheets.columns)).collect())
    return found


def test_a_late_match_and_a_broken_run_end_as_a_run_from_scratch(spark, tmp_path):
    root = json_feed(tmp_path / "json")
    feeds, out = harmonise.Feeds(json=str(root)), str(tmp_path / "out")
    harmonise.run(spark, feeds, out).collect()
    add_match(root, "502")
    status = {r.match_id: r.status for r in harmonise.run(spark, feeds, out).collect()}
    assert status == {"501": "skipped", "502": "ok"}
    fresh = str(tmp_path / "fresh")
    harmonise.run(spark, feeds, fresh).collect()
    whole = written(spark, fresh)
    assert written(spark, out) == whole and len(whole["sheets"]) == 2
    # As after a crash between two outputs: no mark, and later outputs are missing.
    broken = str(tmp_path / "broken")
    (tmp_path / "broken").mkdir()
    (tmp_path / "fresh" / "tracking").rename(tmp_path / "broken" / "tracking")
    assert {r.status for r in harmonise.run(spark, feeds, broken).collect()} == {"ok"}
    assert written(spark, broken) == whole
    # A run that does not resume replaces everything; nothing of the old batch stays.
    harmonise.run(spark, feeds, broken, resume=False).collect()
    assert written(spark, broken) == whole
    assert spark.read.parquet(f"{broken}/tracking").select("batch").distinct().count() == 1


def add_xml_match(root, match_id):
    """A copy of match X1 under another id."""
    for path in list(root.glob("*_X1.xml")):
        path.with_name(path.name.replace("X1", match_id)).write_text(path.read_text())


def test_a_bad_match_fails_alone_with_its_reason(spark, tmp_path):
    xml, js = xml_feed(tmp_path / "xml"), json_feed(tmp_path / "json")
    for name in ("X2", "X3", "X4", "X5"):
        add_xml_match(xml, name)
    for name in ("502", "503", "504"):
        add_match(js, name)
    positions = xml / "F_04_03_positions_raw_observed_A-1_X2.xml"
    positions.write_text(positions.read_text()[:4000])
    (xml / "F_03_02_events_raw_A-1_X3.xml").unlink()
    events = xml / "F_03_02_events_raw_A-1_X4.xml"
    events.write_text(events.read_text().replace('EventId="E9" EventTime=', 'EventId="E9 EventTime='))
    (xml / "F_02_01_matchinformation_A-1_X5.xml").write_text("")
    sheet = js / "matches" / "502" / "502_match.json"
    sheet.write_text(sheet.read_text()[:300])
    (js / "matches" / "503" / "503_tracking_extrapolated.jsonl").write_text("{broken\n")
    feeds, out = harmonise.Feeds(str(xml), str(js)), str(tmp_path / "out")
    rows = {r.match_id: r for r in harmonise.run(spark, feeds, out).collect()}
    assert {m for m, r in rows.items() if r.status == "ok"} == {"X1", "501", "504"}
    assert "closing tag" in rows["X2"].reason and rows["X3"].reason == "no events file, or it is empty"
    assert rows["X4"].reason.startswith("malformed Event") and rows["X5"].reason == "no info file, or it is empty"
    assert rows["502"].reason == "match sheet is not JSON" and "no frame" in rows["503"].reason
    # Once mended, only the failed matches are read; the copies then equal the match they were made from.
    for name in ("X2", "X3", "X4", "X5"):
        add_xml_match(xml, name)
    for name in ("502", "503"):
        for path in (js / "matches" / "501").iterdir():
            (js / "matches" / name / path.name.replace("501", name)).write_text(path.read_text())
    again = {r.match_id: r.status for r in harmonise.run(spark, feeds, out).collect()}
    assert again == {m: "skipped" if m in ("X1", "501", "504") else "ok" for m in rows}
    # The JSON copies have no kick-off time, so what follows from the clock is left out.
    for table, names in (("tracking", ("player_id", "frame_id_source", "x", "y")), ("actions", ("event_id", "player_id", "start_y"))):
        by_match = {m: [] for m in rows}
        for r in harmonise.read(spark, out, table).select("match_id", *names).collect():
            by_match[r.match_id].append(str(tuple(r)[1:]))
        for m in rows:
            assert sorted(by_match[m]) == sorted(by_match["X1" if m.startswith("X") else "501"]), (table, m)
    assert harmonise.read(spark, out, "sheets").count() == len(rows)


def test_an_unforeseen_error_is_narrowed_down_to_its_match(spark, tmp_path, monkeypatch):
    root = json_feed(tmp_path / "json")
    add_match(root, "502")
    plain = harmonise.actions

    def failing(session, feeds):
        return plain(session, feeds).withColumn(
            "result", F.when(F.col("match_id") == "502", F.raise_error(F.lit("bad action"))).otherwise(F.col("result"))
        )

    monkeypatch.setattr(harmonise, "actions", failing)
    out = str(tmp_path / "out")
    rows = {r.match_id: r for r in harmonise.run(spark, harmonise.Feeds(json=str(root)), out).collect()}
    assert {m: r.status for m, r in rows.items()} == {"501": "ok", "502": "failed"}
    assert "bad action" in rows["502"].reason
    assert {r.match_id for r in harmonise.read(spark, out, "actions").collect()} == {"501"}


def test_each_file_is_parsed_once(spark, tmp_path, monkeypatch):
    parsed = []
    plain = XF.materialise

    def counting(df):
        if "FrameSet" in df._jdf.queryExecution().toString() or "Frame" in df.columns or "KickOff" in df.columns:
            parsed.append(tuple(df.columns))
        return plain(df)

    monkeypatch.setattr(XF, "materialise", counting)
    staged = XF.stage(spark, str(xml_feed(tmp_path / "xml")))
    assert len(parsed) == 2
    first = XF.raw_events(spark, staged).select("_EventId", "seq").collect()
    assert sorted((r.seq, r["_EventId"]) for r in first) == [(i, f"E{i}") for i in range(20)]
    plan = XF.tracking(spark, staged)._jdf.queryExecution().executedPlan().toString()
    assert "positions_raw" not in plan  # the position file itself is not read again


def test_pending_without_outputs(spark):
    found = spark.createDataFrame([("a",), ("b",)], "match_id string")
    assert sinks.pending(found, None).count() == 2
    assert [r.match_id for r in sinks.pending(found, found.limit(1)).collect()] == ["b"]


def test_stream_picks_up_only_new_files(spark, tmp_path):
    root = json_feed(tmp_path / "json")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    assert ingest_frames(spark, str(root), out, check) == 1
    assert spark.read.parquet(f"{out}/frames").count() == 40
    assert spark.read.parquet(f"{out}/quarantine").count() == 2
    assert ingest_frames(spark, str(root), out, check) == 0
    second = root / "matches" / "502"
    second.mkdir()
    text = (root / "matches" / "501" / "501_tracking_extrapolated.jsonl").read_text().splitlines()[0]
    (second / "502_tracking_extrapolated.jsonl").write_text(text + "\n")
    assert ingest_frames(spark, str(root), out, check) == 1
    assert spark.read.parquet(f"{out}/frames").groupBy("match_id").count().count() == 2


