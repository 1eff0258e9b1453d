"""Presets: the domain pipelines as compositions of the operators."""
