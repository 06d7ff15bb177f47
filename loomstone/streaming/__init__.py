"""Staged execution against a pluggable model function, and incremental runs."""
