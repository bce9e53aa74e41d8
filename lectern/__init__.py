"""Catalogue ingest, search and ranking expressed as Spark jobs."""
