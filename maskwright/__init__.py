"""Text analytics for privacy and training data on Spark."""
