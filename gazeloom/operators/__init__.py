"""Operators over gaze recordings."""
