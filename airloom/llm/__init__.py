"""Operators for preparing training data: deduplication, scoring, scanning, filtering, mixing and tokenising."""
