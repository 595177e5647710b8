"""Column expressions: text, rules, geography, redaction."""
