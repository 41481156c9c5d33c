"""Column functions: cleaning rules, spoken numbers, speech and audio arithmetic."""
