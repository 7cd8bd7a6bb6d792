"""Readers, writers and run-directory discovery."""
