"""Column expressions: text, URLs, dates, money and metrics."""
