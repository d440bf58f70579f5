"""Property-intelligence analytics, written as Spark DataFrame operators."""
