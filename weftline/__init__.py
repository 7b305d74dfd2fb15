"""Text-configuration and training-data operators on Spark."""
