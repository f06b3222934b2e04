"""Operators for training-data pipelines: text in, decisions and token files out."""
