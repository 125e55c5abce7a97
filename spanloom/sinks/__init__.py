"""sinks of the timed-segment engine."""
