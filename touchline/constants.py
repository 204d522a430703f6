"""Fixed values of the data model.

Everything here is data that results must agree on (names, codes, limits), not logic.
"""

from __future__ import annotations

# Source labels, competition labels and other fixed texts of the harmonised tables.
SOURCE_XML = "DFL"
SOURCE_JSON = "SkillCorner"
COMPETITION_JSON = "A-League"
COMPETITION_XML = {"DFL-COM-000001": "Bundesliga", "DFL-COM-000002": "2.Bundesliga"}
FORMAT_VERSION = "1.0.0"
TRACKER_XML = "TRACAB Gen5"
TRACKER_JSON = "SkillCorner broadcast CV"

# Quality limits and clock constants.
MAX_SPEED_KMH = 40.0
MAX_ACCEL_MS2 = 12.0
HIGH_SPEED_KMH = 19.8
SPRINT_KMH = 25.2
SPEED_BANDS = (
    ("standing", 0.0, 6.0),
    ("jogging", 6.0, 11.0),
    ("running", 11.0, 19.8),
    ("high_speed", 19.8, 25.2),
    ("sprint", 25.2, None),
)
FRAMES_PER_MINUTE = 600
HALF_TIME_BREAK_SECONDS = 900
DEFAULT_PITCH_LENGTH = 105.0
DEFAULT_PITCH_WIDTH = 68.0
PERIOD_SORT_STRIDE = 10_000_000
SMOOTHING_WINDOW = {SOURCE_JSON: 13}
SMOOTHING_ORDER = 2
ACCEL_WINDOW = 7

# Periods in playing order, and the codes the feeds use for them.
PERIODS = (
    "first_half",
    "second_half",
    "first_half_extratime",
    "second_half_extratime",
    "shootout",
)
PERIOD_BY_SECTION = {"firstHalf": "first_half", "secondHalf": "second_half"}
PERIOD_BY_NUMBER = {
    1: "first_half",
    2: "second_half",
    3: "first_half_extratime",
    4: "second_half_extratime",
}
DIRECTIONS = ("left_right", "right_left")
DIRECTION_BY_TEXT = {"left_to_right": "left_right", "right_to_left": "right_left"}
POSITION_GROUPS = ("GK", "DF", "MF", "FW", "SUB")

# Position codes of each feed: code -> (label, group).
POSITIONS_XML = {
    "TW": ("GK", "GK"),
    "IVL": ("LCB", "DF"),
    "IVR": ("RCB", "DF"),
    "IVZ": ("CB", "DF"),
    "LV": ("LB", "DF"),
    "RV": ("RB", "DF"),
    "DML": ("LDM", "MF"),
    "DMR": ("RDM", "MF"),
    "DMZ": ("CDM", "MF"),
    "ZO": ("CAM", "MF"),
    "LM": ("LM", "MF"),
    "RM": ("RM", "MF"),
    "DLM": ("LCM", "MF"),
    "DRM": ("RCM", "MF"),
    "OLM": ("LAM", "MF"),
    "ORM": ("RAM", "MF"),
    "LA": ("LW", "FW"),
    "RA": ("RW", "FW"),
    "HL": ("LW", "FW"),
    "HR": ("RW", "FW"),
    "STZ": ("CF", "FW"),
    "STL": ("LCF", "FW"),
    "STR": ("RCF", "FW"),
    "SUB": (None, "SUB"),
}
POSITIONS_JSON = {
    "GK": ("GK", "GK"),
    "LCB": ("LCB", "DF"),
    "RCB": ("RCB", "DF"),
    "CB": ("CB", "DF"),
    "LB": ("LB", "DF"),
    "RB": ("RB", "DF"),
    "LWB": ("LB", "DF"),
    "RWB": ("RB", "DF"),
    "DM": ("CDM", "MF"),
    "LDM": ("LDM", "MF"),
    "RDM": ("RDM", "MF"),
    "AM": ("CAM", "MF"),
    "LM": ("LM", "MF"),
    "RM": ("RM", "MF"),
    "LW": ("LW", "FW"),
    "RW": ("RW", "FW"),
    "LF": ("LCF", "FW"),
    "RF": ("RCF", "FW"),
    "CF": ("CF", "FW"),
    "SUB": (None, "SUB"),
}
# Label -> tactical role used by the position tasks.
ROLE_BY_LABEL = {
    "GK": "GK",
    "LB": "FB",
    "RB": "FB",
    "LCB": "CB",
    "CB": "CB",
    "RCB": "CB",
    "LDM": "DM",
    "CDM": "DM",
    "RDM": "DM",
    "LCM": "CM/AM",
    "CM": "CM/AM",
    "RCM": "CM/AM",
    "LM": "CM/AM",
    "RM": "CM/AM",
    "LAM": "CM/AM",
    "CAM": "CM/AM",
    "RAM": "CM/AM",
    "LW": "WG",
    "RW": "WG",
    "LCF": "FW",
    "CF": "FW",
    "RCF": "FW",
}

# Action vocabulary.
SHOT_OUTCOMES = {
    "SuccessfulShot": "success",
    "OwnGoal": "own_goal",
    "SavedShot": "saved",
    "BlockedShot": "blocked",
    "ShotWide": "wide",
    "ShotWoodWork": "woodwork",
}
SHOT_DETAILS = ("saved", "blocked", "wide", "woodwork", "own_goal")
PASS_LIKE = (
    "pass",
    "cross",
    "freekick_short",
    "freekick_cross",
    "corner_short",
    "corner_cross",
    "throw_in",
    "goalkick",
)
OFFSIDE_ELIGIBLE = ("pass", "cross", "freekick_short", "freekick_cross", "throw_in")
OFFSIDE_LOOKBACK = 4
COMPARABLE_ACTIONS = ("pass", "shot", "shot_freekick", "throw_in")
SHOT_ACTIONS = ("shot", "shot_freekick", "shot_penalty")
# Action -> (event type, event sub-type); every other action is ("misc", "other_ball_action").
EVENT_TYPE_BY_ACTION = {
    "pass": ("pass", None),
    "cross": ("pass", None),
    "freekick_short": ("pass", "free_kick"),
    "freekick_cross": ("pass", "free_kick"),
    "corner_short": ("pass", "corner_kick"),
    "corner_cross": ("pass", "corner_kick"),
    "throw_in": ("pass", "throw_in"),
    "goalkick": ("pass", "goal_kick"),
    "shot": ("shot", None),
    "shot_freekick": ("shot", "free_kick"),
    "shot_penalty": ("shot", "penalty_kick"),
    "foul": ("referee", "foul"),
    "clearance": ("misc", "other_ball_action"),
    "bad_touch": ("misc", "other_ball_action"),
    "non_action": ("misc", "other_ball_action"),
}

# Column order of the action table.
ACTION_COLUMNS = (
    "event_id", "match_id", "timestamp", "period", "action_type", "player_id", "player_name",
    "team_id", "team_name", "receiver_id", "receiver_time", "body_part", "related_event_ids",
    "result", "start_x", "start_y", "end_x", "end_y", "source", "competition",
    "cross_dataset_comparable",
)
TRACKING_FLOATS = (
    "x", "y", "ball_x", "ball_y", "ball_z", "speed_kmh", "speed_kmh_filtered",
    "acceleration_ms2", "acceleration_ms2_filtered", "distance_m",
)
SNIPPET_FEATURES = ("x", "y", "speed_kmh_filtered", "acceleration_ms2_filtered")

# Parity settings of the evaluation.
SEED = 42
SEEDS = (42, 43, 44, 45, 46)
TRACKING_TRAIN_SIZES = (500, 1000, 2000, 4000, 8000, 16000, 32000)
TARGET_REGIMES = ("target_only", "other_only", "merged_same_n", "target_plus_other_2n")
