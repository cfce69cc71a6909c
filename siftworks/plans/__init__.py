"""Whole jobs: scans put together from operators, and the query catalogue."""
