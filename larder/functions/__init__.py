"""Column functions: text identity, unit prices, detectors."""
