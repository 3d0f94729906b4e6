"""Per-group ordered-sequence selection, answer parsing and accuracy roll-ups on Spark DataFrames."""
