"""Carbon and resource accounting as Spark DataFrame operators and reports."""
