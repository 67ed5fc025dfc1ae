"""Session plumbing and the registered queries."""
