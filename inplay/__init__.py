"""In-play pricing analytics on Spark: event sequences, as-of prices, forecast evaluation."""
