"""Readers and writers: message streams and file tables."""
