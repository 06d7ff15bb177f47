"""Scans and sinks: triples, knowledge bases, numbered files, literals, records."""
