"""Where indexes are kept."""
