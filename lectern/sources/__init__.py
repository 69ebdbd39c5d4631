"""Lectern: sources."""
