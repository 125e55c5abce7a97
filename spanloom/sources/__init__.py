"""sources of the timed-segment engine."""
