"""Column expressions: text rules, ratings, labels."""
