"""Imports the query modules, which register themselves."""

from . import catalogs, decisions, details, feature_sets, features, feeds, fits, frames, gates, identity, ingest, lookups, markets, monitoring, payloads, records, relations, settlement, streams  # noqa: F401
