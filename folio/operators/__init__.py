"""Operators over whole DataFrames: triage, scoring, analytics, layout, experiments, inference."""
