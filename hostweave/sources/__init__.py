"""Readers and parsers of landed captures, inventories, logs and specifications."""
