"""Operators that prepare archive texts for language-model training. Nothing else in the library imports this package."""
