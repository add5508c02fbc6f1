"""pressgrain functions."""
