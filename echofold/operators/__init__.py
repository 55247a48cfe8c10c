"""operators of the duplicate-detection engine."""
