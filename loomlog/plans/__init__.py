"""Whole jobs composed from the operators, and shared ordered-computation helpers."""
