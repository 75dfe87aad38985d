"""rangeweave: an ordered, multi-versioned key space expressed as Spark DataFrames."""
