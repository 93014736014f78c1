"""Registered queries; importing the package registers all of them."""

from sparkloom.plans import calls, kept, listings, migration, pipelines, relational, retrieval, searches, sources, texts, trees  # noqa: F401
