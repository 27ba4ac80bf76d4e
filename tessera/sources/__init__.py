"""Readers and text formats."""
