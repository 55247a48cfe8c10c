"""functions of the duplicate-detection engine."""
