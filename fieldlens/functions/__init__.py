"""Column expressions: rates, volumes, dates, labels."""
