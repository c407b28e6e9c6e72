"""A library of catalog, inventory, event and document analytics on Spark DataFrames."""
