"""Sources, sinks and the adapter from the supplied tables."""
