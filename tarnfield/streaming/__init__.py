"""Incremental maintenance of features from streams of child rows."""
