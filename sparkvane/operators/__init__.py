"""Collections, indexes and adapters over DataFrames."""
