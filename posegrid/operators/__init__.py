"""Operators on data frames: hierarchies, key reduction, retargeting, checks."""
