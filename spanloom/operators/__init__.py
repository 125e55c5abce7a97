"""operators of the timed-segment engine."""
