"""lodestone: code- and text-search analytics expressed as Spark DataFrames."""
