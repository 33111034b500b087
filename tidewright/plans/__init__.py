"""Plans that put operators together, and the registry of queries."""
