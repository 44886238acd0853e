"""sources of pagemill."""
