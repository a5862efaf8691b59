"""Column expressions: text shapes and spans, check digits, dates."""
