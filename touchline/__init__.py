"""touchline: point-in-time analytics for two-sided contests, written as Spark DataFrame operators."""
