"""Readers, writers and the driver tables seen as night-light tables."""
