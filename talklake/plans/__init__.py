"""Named queries over a folder of archive tables, with their SQL."""
