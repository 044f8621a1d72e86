"""Reports of a comparison."""
