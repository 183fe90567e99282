"""Trajectory analytics on Spark: tracks, intervals, scenes, events, risk and evaluation as DataFrame jobs."""
