"""Spark jobs for media-library triage, quality checks and catalog upkeep."""
