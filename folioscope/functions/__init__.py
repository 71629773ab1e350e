"""Column functions: text, dates, page hashes."""
