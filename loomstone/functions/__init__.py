"""Column functions: text extraction, answer parsing, set metrics."""
