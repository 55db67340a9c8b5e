"""Structured Streaming: state machines over event streams."""
