"""Statistics from distributed sufficient statistics."""
