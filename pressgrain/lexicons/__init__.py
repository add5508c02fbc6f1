"""pressgrain lexicons."""
