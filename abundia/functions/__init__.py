"""Column expressions: text keys, labels and guarded arithmetic."""
