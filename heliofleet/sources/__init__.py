"""Feeds in and data sets out."""
