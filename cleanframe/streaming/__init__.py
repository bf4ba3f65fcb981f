"""The library on streaming frames."""
from .feeds import capacity_stream, clean_stream, conform_stream, first_arrivals, late_rows, windowed_counts

__all__ = ["capacity_stream", "clean_stream", "conform_stream", "first_arrivals", "late_rows", "windowed_counts"]
