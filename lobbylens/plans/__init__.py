"""Composite jobs built from the operators: feature vectors and segments."""
