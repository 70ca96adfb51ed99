"""Operators for training-data pipelines over text. Nothing else in barflow imports this subpackage."""
