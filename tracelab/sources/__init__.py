"""Readers, writers and control of artifacts."""
