"""Scalar column expressions: clocks, ids, codes, units, orientation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import constants as K


def lookup(col: Column, mapping: Mapping[str, object], default: Column | None = None) -> Column:
    """Code-table lookup as a literal map: no join, null (or ``default``) on a miss."""
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    found = F.try_element_at(table, col)
    return found if default is None else F.coalesce(found, default)


def to_utc(raw: Column) -> Column:
    """Parse ISO-8601 text; text without an offset counts as UTC; junk becomes null.

    Independent of the session time zone.
    """
    bare = raw.contains(":") & ~raw.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$")
    return F.try_to_timestamp(F.when(bare, F.concat(raw, F.lit("+00:00"))).otherwise(raw))


def iso_text(ts: Column) -> Column:
    """Render a timestamp as ISO-8601 UTC, with microseconds only where they exist."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, F.coalesce(fraction, F.lit("")), F.lit("+00:00"))


def iso_normalise(raw: Column) -> Column:
    """UTC ISO text; empty becomes null and unparseable text passes through unchanged."""
    given = F.when(raw != "", raw)
    return F.coalesce(iso_text(to_utc(given)), given)


def clock_seconds(clock: Column, *, two_part: bool = True) -> Column:
    """Seconds of an ``HH:MM:SS.ss`` (or ``MM:SS.s``) clock; 0 when it does not parse."""
    parts = F.split(clock, ":")
    n = F.size(parts)

    def whole(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("int")

    def real(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("double")

    three = whole(0) * 3600 + whole(1) * 60 + real(2)
    value = F.when(n == 3, three)
    if two_part:
        value = value.when(n == 2, whole(0) * 60 + real(1))
    return F.coalesce(value, F.lit(0.0))


def shift_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * 1_000_000).cast("long"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def hms(seconds: Column) -> Column:
    """``HH:MM:SS`` of elapsed seconds; null when negative."""
    whole = F.floor(seconds).cast("long")
    text = F.format_string(
        "%02d:%02d:%02d",
        F.floor(whole / 3600).cast("long"),
        F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"),
        F.pmod(whole, F.lit(60)),
    )
    return F.when(seconds >= 0, text)


def match_minute(clock_s: Column, period: Column) -> Column:
    base = F.when(period == 2, 45).otherwise(0)
    return (base + F.floor(clock_s / 60) + 1).cast("int")


def recentre(corner: Column, extent: float) -> Column:
    """Corner-origin metres to centre-origin metres."""
    return corner - F.lit(extent / 2)


def flip_if(value: Column, direction: Column) -> Column:
    """Mirror ``value`` where the home side attacked right to left."""
    return F.when(direction.isin("right_left", "right_to_left"), -value).otherwise(value)


def opposite(direction: Column) -> Column:
    return F.when(direction == "left_right", "right_left").when(
        direction.isNotNull(), "left_right"
    )


def clean_id(raw: Column) -> Column:
    """Numeric ids without the decimal tail ('51649.0' -> '51649'); other text unchanged."""
    return F.coalesce(raw.try_cast("double").try_cast("bigint").cast("string"), raw)


def kmh_to_ms(kmh: Column) -> Column:
    return F.round(kmh / F.lit(3.6), 3)


def winner(home_score: Column, away_score: Column, home_id: Column, away_id: Column) -> Column:
    return F.when(home_score > away_score, home_id).when(away_score > home_score, away_id)


def left_team(direction: Column, home_id: Column, away_id: Column) -> Column:
    return F.when(direction == "left_right", home_id).when(direction == "right_left", away_id)


def right_team(direction: Column, home_id: Column, away_id: Column) -> Column:
    return left_team(direction, away_id, home_id)


def possession_by_code(code: Column, home_id: Column, away_id: Column) -> Column:
    return F.when(code == 1, home_id).when(code == 2, away_id)


def possession_by_group(
    player_team: Column, group: Column, home_id: Column, away_id: Column
) -> Column:
    """Team of the named player, else the team the group label points at."""
    by_label = F.when(group == "home team", home_id).when(group == "away team", away_id)
    return F.coalesce(player_team, by_label)


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.abs(no_nan(value)) < F.lit(float("inf")), value)


def cap(value: Column, limit: float) -> Column:
    """Null where the magnitude exceeds ``limit``."""
    return F.when(F.abs(value) <= limit, value)


def hidden_to_null(value: Column, source: Column, visible: Column, masked_source: str) -> Column:
    hidden = (source == masked_source) & ~F.coalesce(visible, F.lit(False))
    return F.when(~hidden, value)


def role_of(label: Column) -> Column:
    return lookup(label, K.ROLE_BY_LABEL)


def event_type(action: Column) -> Column:
    table = {a: t for a, (t, _) in K.EVENT_TYPE_BY_ACTION.items()}
    return lookup(action, table, F.lit("misc"))


def event_sub_type(action: Column) -> Column:
    known = {a: s for a, (_, s) in K.EVENT_TYPE_BY_ACTION.items() if s}
    plain = [a for a, (_, s) in K.EVENT_TYPE_BY_ACTION.items() if s is None]
    return F.when(
        ~action.isin(plain), lookup(action, known, F.lit("other_ball_action"))
    )


def success_flag(result: Column) -> Column:
    failed = ("fail", "offside", *K.SHOT_DETAILS)
    return F.when(result == "success", True).when(result.isin(*failed), False)


def outcome_type(action: Column, result: Column) -> Column:
    won = F.when(result == "success", "successful")
    shot = F.when(result.isin(*K.SHOT_DETAILS), result).otherwise(won)
    passed = won.when(result.isin("offside", "fail"), "out_of_play")
    return (
        F.when(action.startswith("shot"), shot)
        .when(action.isin(*K.PASS_LIKE), passed)
        .when(action == "clearance", "successful")
        .when(action.isin("bad_touch", "non_action"), "unsuccessful")
    )


def comparable(action: Column) -> Column:
    return action.isin(*K.COMPARABLE_ACTIONS)


def canonical_source(raw: Column, names: Iterable[str] = (K.SOURCE_XML, K.SOURCE_JSON)) -> Column:
    """Known source names regardless of case; other text unchanged."""
    return lookup(F.lower(raw), {name.lower(): name for name in names}, raw)


def one_hot(col: str, categories: Iterable[str], prefix: str | None = None) -> list[Column]:
    """One 0/1 column per category; a null value is 0 everywhere."""
    stem = prefix or col
    return [
        F.coalesce((F.col(col) == F.lit(value)).cast("int"), F.lit(0)).alias(f"{stem}_{value}")
        for value in categories
    ]


def second_half(period: Column) -> Column:
    return F.coalesce((period == "second_half").cast("int"), F.lit(0))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def pass_geometry(
    start_x: str = "start_x", start_y: str = "start_y", end_x: str = "end_x", end_y: str = "end_y"
) -> dict[str, Column]:
    dx = F.col(end_x) - F.col(start_x)
    dy = F.col(end_y) - F.col(start_y)
    return {
        "pass_dx": dx,
        "pass_dy": dy,
        "pass_length_m": F.sqrt(dx * dx + dy * dy),
        "pass_angle_rad": F.atan2(dy, dx),
        "forward_progress_m": dx,
    }


def shot_geometry(
    start_x: str = "start_x",
    start_y: str = "start_y",
    *,
    goal_x: float = K.DEFAULT_PITCH_LENGTH / 2,
    away: Column | None = None,
) -> dict[str, Column]:
    """Distance and angle to the goal at +x; with ``away`` those shots aim at -x instead."""
    x = F.col(start_x) if away is None else F.when(away, -F.col(start_x)).otherwise(F.col(start_x))
    y = F.col(start_y)
    ahead = F.lit(goal_x) - x
    return {
        "abs_y": F.abs(y),
        "dist_to_goal_m": F.sqrt(ahead * ahead + y * y),
        "angle_to_goal": F.atan2(F.abs(y), F.greatest(ahead, F.lit(0.1))),
    }
