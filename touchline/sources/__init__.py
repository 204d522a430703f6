"""Readers and writers for the raw feeds and the harmonised tables."""
