"""Readers, writers and the views that queries share."""
