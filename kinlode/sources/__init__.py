"""Strict readers, result lists and their checks."""
