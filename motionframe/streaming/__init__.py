"""Structured Streaming forms of the window and alarm operators."""
