"""Indicators over lists, over ordered rows, over calendar-aligned rows, and as one wide table."""
