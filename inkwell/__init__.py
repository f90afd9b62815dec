"""Document-record analytics and training-data operators on Spark."""
