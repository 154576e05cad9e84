"""Whole queries: the review engine, and the operator shapes over the benchmark tables."""
