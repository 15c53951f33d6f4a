"""Registered queries, each next to its SQL twin."""
