"""Continuity analytics over fleets of sequential-media repair projects, on Spark DataFrames."""
