"""The same data flow on arriving files."""
