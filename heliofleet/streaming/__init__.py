"""Rollups, deduplication, upserts and alerts kept current from a stream."""
