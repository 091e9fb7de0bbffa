"""Evaluation event by event: the monitor and Structured Streaming queries."""
