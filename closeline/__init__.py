"""Spark operators for priced forecasts: quotes, captures, results, statistics."""
