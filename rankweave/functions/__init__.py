"""Column functions: names, texts, scores."""
