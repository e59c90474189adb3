"""Column functions: text, scores, labels."""
