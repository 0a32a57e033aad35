"""The analyses: each one is a single DataFrame plan over all series at once."""
