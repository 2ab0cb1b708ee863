"""ledgerloom: trade analytics as Spark DataFrame transformations."""
