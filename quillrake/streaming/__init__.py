"""Change feeds and event-time streams."""
