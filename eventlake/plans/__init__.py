"""Whole queries, models and jobs."""
