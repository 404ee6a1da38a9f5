"""millrace: text-evaluation and dataset-building analytics on Spark."""
