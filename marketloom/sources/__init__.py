"""Readers, writers and the builders of bar tables."""
