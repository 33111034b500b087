"""Sources, sinks and the domain views over the given tables."""
