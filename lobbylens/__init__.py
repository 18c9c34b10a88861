"""Match telemetry, rating labels and lobby scoring on Spark DataFrames."""
