"""Lectern: streaming."""
