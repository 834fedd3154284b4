"""Market-intelligence analytics as Spark DataFrame operators."""
