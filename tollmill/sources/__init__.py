"""Readers, writers, schemas and dimensions."""
