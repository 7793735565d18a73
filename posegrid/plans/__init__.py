"""Queries: the library's operators over the driver's tables, each beside its SQL."""
