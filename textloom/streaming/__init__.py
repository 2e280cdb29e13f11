"""Streams over the same operators."""
