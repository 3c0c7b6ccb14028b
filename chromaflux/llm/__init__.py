"""Operators for large-scale training-text pipelines; nothing else in the library imports this subpackage."""
