"""Readers, writers and table fingerprints."""
