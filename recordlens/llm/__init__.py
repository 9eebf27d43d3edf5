"""Operators for preparing training data at scale, with their queries and SQL."""
