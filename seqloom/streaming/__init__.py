"""Stateless sequence functions over streams."""
