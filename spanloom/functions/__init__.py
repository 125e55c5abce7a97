"""functions of the timed-segment engine."""
