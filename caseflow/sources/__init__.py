"""Readers, writers and record decoding."""
