"""Checks, repairs and analyses of large map deliveries as Spark tables."""
