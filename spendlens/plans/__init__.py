"""Physical choices: join strategy, written intermediates, exact quantiles."""
