"""pressgrain operators."""
