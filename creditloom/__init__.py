"""Credit-panel analytics expressed as Spark DataFrame transformations."""
