"""Operators of a training-data pipeline: formatting, scanning, scoring, deduplication, tokenizing, sharding and writing."""
