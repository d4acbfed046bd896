"""Runs driven by Structured Streaming."""
