"""Readers, schemas and the application and audit views over the base tables."""
