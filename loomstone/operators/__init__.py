"""Sampling, perturbation, audits, summaries, statistics and the semantic-program front end."""
