"""Structured Streaming forms of progress, debouncing, deadlines and resume."""
