"""Operators over documents and spans."""
