"""Empty by design: the planning engine is batch only, and its one use of time is a cache's expiry."""
