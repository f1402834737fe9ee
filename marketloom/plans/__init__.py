"""Registered queries on the test tables, each next to its SQL."""
