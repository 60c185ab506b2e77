"""Readers, writers and column discovery."""
