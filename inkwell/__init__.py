"""Page analysis on Spark: every stage is a DataFrame-to-DataFrame operator."""
