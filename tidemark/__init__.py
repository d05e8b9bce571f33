"""Tidemark: analytics over tables whose every row version knows the log position it lived at."""
