"""Streaming forms: state per image, resumable output, and windows on event time."""
