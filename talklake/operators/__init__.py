"""Relational and data-processing operators over archive tables."""
