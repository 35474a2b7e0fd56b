"""Structured Streaming jobs: request scoring (ST1) and running station-year weather (ST2)."""
