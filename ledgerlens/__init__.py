"""Decision-audit analytics expressed as Spark DataFrame transformations."""
