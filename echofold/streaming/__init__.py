"""streaming of the duplicate-detection engine."""
