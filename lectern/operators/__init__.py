"""Lectern: operators."""
