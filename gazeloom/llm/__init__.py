"""Training-data operators: tokenising, language ID, de-duplication, cleaning, media.

Nothing outside this package imports it. ``queries.py`` holds the query and
oracle registry that ``__spark_entry__`` picks up when the package is present.
"""
