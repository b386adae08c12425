"""Readers, writers and the schema of the event log."""
