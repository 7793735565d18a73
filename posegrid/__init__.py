"""Skeletal-motion analytics on Spark: quaternions, hierarchies, key reduction, retargeting, reports."""
