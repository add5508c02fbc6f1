"""pressgrain sources."""
