"""Structured Streaming: continuous refresh, and windows over events."""
