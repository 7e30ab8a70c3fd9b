"""Freshet: river, weather and snow data preparation on Spark DataFrames."""

from freshet.session import build_session, configure, scratch_dir

__all__ = ["build_session", "configure", "scratch_dir"]
