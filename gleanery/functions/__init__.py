"""Column functions: URLs, text, coercion, JSON paths, heuristics."""
