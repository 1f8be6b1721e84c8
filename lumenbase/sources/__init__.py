"""Readers and writers of files."""
