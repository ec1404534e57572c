"""Operators for preparing language-model training data.  Nothing else in digestflow imports this subpackage."""
