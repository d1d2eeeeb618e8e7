"""loomlake: DataFrame operators for building, auditing and scoring training data on Spark."""
