"""Sources, sinks and the adapter from the star schema."""
