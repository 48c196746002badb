"""Time-stamped text, sampled signals and labelled events as Spark DataFrames."""

from tidemark.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
