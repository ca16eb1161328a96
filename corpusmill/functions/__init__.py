"""Column functions: text, time, scores, vectors."""
