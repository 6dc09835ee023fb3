"""DataFrame operators over bar series."""
