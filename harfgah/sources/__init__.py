"""Readers with explicit schemas, sinks, and codecs of the compact tables."""
