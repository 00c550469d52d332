"""Parsing and small numeric rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hoopflow import fixed as K
from hoopflow.functions.geometry import _c


def clock_seconds(text) -> Column:
    """'MM:SS(.s)' to seconds; NULL unless exactly two parts parse."""
    parts = F.split(_c(text), ":")
    mins, secs = parts.getItem(0).try_cast("int"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 2, mins * 60 + secs)


def points_scored(event_type, description) -> Column:
    """3 or 2 for a made field goal, 1 for a made free throw, else 0."""
    t, d = _c(event_type), _c(description)
    return (F.when(t == K.MADE, F.when(d.contains("3PT"), 3).otherwise(2))
            .when((t == K.FREE_THROW) & ~d.contains("MISS"), 1).otherwise(0))


def class_of(name) -> Column:
    low = F.lower(_c(name))
    words = F.split(low, "[^a-z]+")
    out = None
    for needle, ours in K.CLASS_NEEDLES:
        hit = low.contains(needle) if " " in needle else F.array_contains(words, needle)
        out = F.when(hit, ours) if out is None else out.when(hit, ours)
    return out


def safe_int(text) -> Column:
    return F.trim(_c(text)).try_cast("long")


def finite_or(value, default: float) -> Column:
    v = _c(value)
    inf = F.lit(float("inf"))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == inf), F.lit(default)).otherwise(v)


def confidence(n_players, homography_ok, identity_mean, ball_recent) -> Column:
    return (K.CONF_PLAYERS * F.least(_c(n_players) / 10.0, F.lit(1.0))
            + K.CONF_HOMOGRAPHY * _c(homography_ok).cast("int")
            + K.CONF_IDENTITY * F.coalesce(_c(identity_mean), F.lit(0.0))
            + K.CONF_BALL * _c(ball_recent).cast("int"))


def _clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def augment_recommendation(err_ft, miss_rate, id_error) -> dict[str, Column]:
    """Training-noise settings derived from measured recovery error."""
    jitter = F.bround(_clamp(_c(err_ft) * 1.2, 0.5, 4.0), 2)
    return {"jitter_ft": jitter,
            "dropout_prob": F.bround(_clamp(_c(miss_rate) * 2.0, 0.1, 0.9), 2),
            "dropout_max": F.when(_c(miss_rate) < 0.2, 2).otherwise(3),
            "id_swap_prob": F.bround(_clamp(_c(id_error), 0.02, 0.5), 3),
            "vel_lag_ft": F.bround(jitter * 0.5, 2)}


def fallback_id(player_id, track_id) -> Column:
    return F.coalesce(_c(player_id), -(1000 + _c(track_id)))


def team_of_track(team_id, team_label) -> Column:
    return F.coalesce(_c(team_id), _c(team_label))


def group_key(source) -> Column:
    return F.substring_index(_c(source), "@", 1)


def action_label(action, direction, q) -> Column:
    a, val = _c(action), F.format_string("%.2f", _c(q))
    head = (F.when(a == "PASS_TO", "PASS").when(a == "SCREEN_WITH", "SCREEN")
            .when(a == "DRIVE", F.concat(F.lit("DRIVE "), _c(direction))).otherwise(a))
    return F.concat(head, F.lit(" (EPV "), val, F.lit(")"))


def player_label(name, jersey, default=None) -> Column:
    return F.coalesce(_c(name), F.concat(F.lit("#"), _c(jersey).cast("string")), F.lit(default).cast("string"))
