"""Race-timing analytics as Spark DataFrame transformations."""
