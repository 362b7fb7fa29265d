"""Queries over the driver tables and staged pipelines."""
