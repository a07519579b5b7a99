"""Whole jobs: the daily run, and the queries registered for checking and timing."""
