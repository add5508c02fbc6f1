"""pressgrain streaming."""
