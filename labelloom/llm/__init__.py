"""Operators for training-data pipelines over text, vectors, web pages and conversations."""
