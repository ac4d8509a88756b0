"""Reusable DataFrame building blocks shared by the plans."""
