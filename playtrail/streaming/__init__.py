"""Structured Streaming into the flat event table."""
