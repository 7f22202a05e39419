"""Architecture analysis of source repositories, and of data shaped like them, on Spark."""
