"""Operators of a large text-corpus pipeline; nothing else in the library imports them."""
