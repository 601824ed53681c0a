"""Building blocks: SQL dialects and per-sample expressions."""
