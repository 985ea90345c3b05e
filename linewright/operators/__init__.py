"""Operators on line frames: templates, features, distances, clustering, topics, metrics and experiments."""
