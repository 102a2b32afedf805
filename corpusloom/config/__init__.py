"""Configuration: layered sources, strict fields, names and paths."""
