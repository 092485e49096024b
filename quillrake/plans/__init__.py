"""SQL frontend and session."""
