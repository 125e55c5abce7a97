"""plans of the timed-segment engine."""
