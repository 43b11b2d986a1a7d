"""Operators for large training-data pipelines, one module an operator."""
