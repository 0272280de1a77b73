"""Reading and writing archive tables."""
