"""Lectern: functions."""
