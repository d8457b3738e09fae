"""mirrorlake: near-duplicate search, review and clean-up of picture indexes on Spark DataFrames."""
