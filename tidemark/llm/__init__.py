"""Operators for training-data pipelines: texts, pages, vectors and conversations. Nothing else in the library imports this package."""
