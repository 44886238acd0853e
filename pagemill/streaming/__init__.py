"""streaming of pagemill."""
