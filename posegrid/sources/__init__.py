"""Clip files as tables: motion text, the key container, arrays, profiles and manifests."""
