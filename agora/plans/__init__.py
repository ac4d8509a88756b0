"""The user-facing queries and table jobs."""
