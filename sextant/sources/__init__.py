"""Readers, snapshot storage and repository sources."""
