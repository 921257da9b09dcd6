"""Readers, writers and test-table views."""
