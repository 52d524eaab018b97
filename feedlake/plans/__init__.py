"""Stages, jobs and the query catalogue."""
