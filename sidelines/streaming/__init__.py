"""Incremental upkeep of the play-level facts with Structured Streaming."""

from sidelines.streaming.incremental import *  # noqa: F401,F403
