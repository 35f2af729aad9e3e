"""Business metrics on Spark: from contracts and sources to findings, causes and decisions."""
