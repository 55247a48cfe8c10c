"""sources of the duplicate-detection engine."""
