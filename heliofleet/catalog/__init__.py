"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from . import (aggregates, features, finance, ingest, joins, models, projections, quality, solar,
               streams, weather, windows)

FAMILIES = (ingest, projections, joins, aggregates, quality, windows, solar, finance, weather,
            features, models, streams)


def all_queries():
    return {name: q.run for family in FAMILIES for name, q in family.CATALOG.items()}


def all_oracles():
    return {name: q.sql for family in FAMILIES for name, q in family.CATALOG.items() if q.sql}
