"""Distributed operators over the log of accepted events."""
