"""Readers and writers of page exports, Markdown trees, scopes and responses."""
