"""Matching operators over candidate pairs."""
