"""Readers, header handling and writers."""
