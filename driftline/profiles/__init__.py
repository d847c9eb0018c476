"""Ready-made column roles of known fact tables."""
