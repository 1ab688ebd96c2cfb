"""Cleaning, curated fact, metric queries, quality report and audit."""
