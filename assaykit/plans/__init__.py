"""Whole programs made of the operators, the model registry and the query catalogue."""
