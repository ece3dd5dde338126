"""Operators over version logs, traces and metric series."""
