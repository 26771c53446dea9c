"""The matcher from end to end, and the queries."""
