"""Bodies of three formats normalized into one semantic tree."""
