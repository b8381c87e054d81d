"""Readers that give the items schema, and writers."""
