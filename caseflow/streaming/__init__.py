"""Structured Streaming jobs; each equals its batch operator on the same input."""
