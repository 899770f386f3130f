"""Writing recordings, training samples, statistics and indexes."""
