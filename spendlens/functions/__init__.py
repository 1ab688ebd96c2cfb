"""Column expressions: text cleaning, casts, dates and metrics."""
