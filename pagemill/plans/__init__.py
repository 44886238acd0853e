"""plans of pagemill."""
