"""Readers, writers and builders of input shapes."""
