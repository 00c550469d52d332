"""Loads every query module so that the registry is complete."""

from hoopflow.plans import q_geometry, q_possessions, q_state, q_actions, q_labels, q_series, q_video, q_models, q_text, q_streaming  # noqa: F401
from hoopflow.plans.registry import Source


def flagship(spark, sf_dir):
    return q_possessions.who_holds_where(Source(spark, sf_dir))
