"""Aggregates that can follow a stream."""
