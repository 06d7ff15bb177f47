"""Logical queries: the intermediate form, lowering to joins, evidence, prompts."""
