"""Readers, input screening and writers."""
