"""Column functions: words, scripts, ratios, scores and their text forms."""
