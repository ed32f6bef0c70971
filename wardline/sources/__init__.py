"""Readers, writers and generators of events."""
