"""Frames, alignment, trees."""
