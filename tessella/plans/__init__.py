"""Whole plans: settings, providers, indexing, querying, evaluation and the query catalogue."""
