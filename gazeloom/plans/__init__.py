"""The catalogue of queries over the driver's tables."""
