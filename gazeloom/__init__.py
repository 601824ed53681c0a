"""Gaze analytics on PySpark: events, scanpaths, areas of interest, signals and their metrics."""
