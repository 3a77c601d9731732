"""Readers, writers and synthetic generators."""
