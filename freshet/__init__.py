"""Batch jobs for river flood forecasts, and training-data operators, on Spark."""
