"""Structured Streaming counterparts of the window operators."""
