"""Shop analytics and order processing as Spark jobs."""
