"""Queries that come as a stream."""
