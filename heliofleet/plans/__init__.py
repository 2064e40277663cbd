"""Compositions of operators: feature sets, reports, models."""
