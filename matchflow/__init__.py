"""matchflow: posting/profile matching at table scale, as plain Spark jobs."""
