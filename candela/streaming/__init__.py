"""Bars and running indicators over streams."""
