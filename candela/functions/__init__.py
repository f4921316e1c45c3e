"""Indicator kernels, candle rules, statistics and market rules."""
